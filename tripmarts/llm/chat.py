r"""Chat formatting from reply trees, with DataFrame functions only.

A row is a message: conversation, node, parent, role, text, score. Iterative self-joins with doubled jumps give every message its root,
its depth and the score of its path (sum of the scores from the root), in rounds that grow with the logarithm of the depth. Leaves are
ranked within their conversation by path score, then depth, then node; the first `branches` of them are chosen; doubled jumps mark
the messages on their way to the root. Each chosen path is formatted as one conversation. Joins are on (conversation, node), so
no conversation is a hot key; rounds are checkpointed in the shared folder. Only the final text of a path is put together in
one place, as it is one value.

Template: `### role: text</turn>` and a line end per turn. In texts and roles, `\`, `###`, `</turn>` (and `:` in roles) get a `\` in front; taking
away a `\` before any character gives the text back. The loss mask is the list of spans (start, length in code points) of assistant
texts in the formatted conversation, still escaped.

Null texts and roles are empty; a null score is 0; null conversations are one conversation of their own; a null node is a node. Equal
rows count once. A message whose parent isn't there is a root. Messages on a circle of parents have no root and are on no path. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmarts import lineage

ASSISTANT = "assistant"
#: A turn as a Java pattern: role and text, both escaped. Possessive, so long texts need no stack.
ROLE = r"(?:\\.|[^\\:])*+"
BODY = r"(?:\\.|[^\\<]|<(?!/turn>))*+"
TURN = rf"(?s)### ({ROLE}): ({BODY})</turn>\n"


def escape(c: Column, role: bool = False) -> Column:
    return F.regexp_replace(c, r"(\\|###|</turn>" + ("|:" if role else "") + ")", r"\\$1")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def replies_in_order(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Messages numbered by turn as a reply tree: each answers the message of the turn before.

    Different rows of one turn are alternatives; the next turn answers the first of them by hash.
    """
    flat = rows.select(F.struct(rows[conv_col].alias("conv")).alias("c"), rows[turn_col].alias("turn"), F.coalesce(rows[role_col].cast("string"), F.lit("")).alias("role"),
                       F.coalesce(rows[text_col].cast("string"), F.lit("")).alias("text"))
    nodes = flat.withColumn("h", F.sha2(F.concat_ws("\n", F.sha2("role", 256), F.sha2("text", 256)), 256)).withColumn("node", F.struct("turn", "h"))
    heads = nodes.groupBy("c", "turn").agg(F.min("node").alias("head"))
    before = heads.select(F.col("c").alias("c2"), F.col("turn").alias("turn2"), F.lag("head").over(Window.partitionBy("c").orderBy("turn")).alias("parent"))
    return nodes.join(before, (nodes["c"] == before["c2"]) & nodes["turn"].eqNullSafe(before["turn2"])).select(F.col("c.conv").alias("conv"), "node", "parent", "role", "text", F.lit(1.0).alias("score"))


def rows_in_order(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Every row as a message that answers the row before: by turn, then hash; equal rows are messages of their own."""
    flat = rows.select(F.struct(rows[conv_col].alias("conv")).alias("c"), rows[turn_col].alias("turn"), F.coalesce(rows[role_col].cast("string"), F.lit("")).alias("role"),
                       F.coalesce(rows[text_col].cast("string"), F.lit("")).alias("text"))
    nodes = flat.withColumn("h", F.sha2(F.concat_ws("\n", F.sha2("role", 256), F.sha2("text", 256)), 256))
    nodes = nodes.withColumn("node", F.row_number().over(Window.partitionBy("c").orderBy("turn", "h")).cast("long"))
    return nodes.select(F.col("c.conv").alias("conv"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def chosen_paths(tree: DataFrame, branches: int = 1) -> DataFrame:
    """(c, node, path, depth) of each message on a chosen path; c is the conversation in a struct, path the rank of the branch."""
    flat = tree.select(F.struct("conv").alias("c"), F.struct("node").alias("node"), F.struct("parent").alias("parent"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    nodes = lineage.cut(flat.groupBy("c", "node").agg(F.min("parent").alias("parent"), F.max("score").alias("score")))
    there = nodes.select(F.col("c").alias("pc"), F.col("node").alias("pn"))
    linked = nodes.join(there, (F.col("c") == F.col("pc")) & (F.col("parent") == F.col("pn")), "left")
    # up: the ancestor 2^k steps above (null: there is none); depth and total cover the steps so far
    state = lineage.cut(linked.select("c", "node", F.when(F.col("pn") != F.col("node"), F.col("pn")).alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")))
    children = state.where("up IS NOT NULL").select(F.col("c").alias("pc"), F.col("up").alias("pn")).distinct()
    leaves = state.join(children, (F.col("c") == F.col("pc")) & (F.col("node") == F.col("pn")), "left_anti").select("c", "node")
    jumps = []
    rounds = 1 + math.ceil(math.log2(max(2, nodes.count())))
    # messages whose root is found are done and are only looked up; the others double their step
    going, done = state.where("up IS NOT NULL"), state.where("up IS NULL")
    while len(jumps) < rounds and not going.isEmpty():
        jumps.append(going.select("c", "node", "up"))
        above = going.unionByName(done).select(F.col("c").alias("pc"), F.col("node").alias("pn"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        state = lineage.cut(going.join(above, (F.col("c") == F.col("pc")) & (F.col("up") == F.col("pn"))).select(
            "c", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("total") + F.col("total2")).alias("total")))
        going, done = state.where("up IS NOT NULL"), done.unionByName(state.where("up IS NULL"))
    done = done.select("c", "node", "depth", "total")
    ranked = leaves.join(done, ["c", "node"]).withColumn("path", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("total"), F.desc("depth"), "node")))
    marked = lineage.cut(ranked.where(F.col("path") <= branches).select("c", "node", "path"))
    for jump in jumps:
        marked = lineage.cut(marked.unionByName(marked.join(jump, ["c", "node"]).select("c", F.col("up").alias("node"), "path")))
    return marked.join(done, ["c", "node"]).select("c", "node", "path", "depth")


def format_chats(tree: DataFrame, branches: int = 1) -> DataFrame:
    """One row per chosen path of tree (conv, node, parent, role, text, score): conv, path, formatted, loss_mask."""
    texts = tree.select(F.struct("conv").alias("c"), F.struct("node").alias("node"), F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said"))
    texts = texts.groupBy("c", "node").agg(F.min("said").alias("said"))
    turns = texts.join(chosen_paths(tree, branches), ["c", "node"])
    head = F.concat(F.lit("### "), escape(F.col("said.role"), role=True), F.lit(": "))
    body = escape(F.col("said.text"))
    shown = turns.select("c", "path", "depth", F.col("said.role").alias("role"), head.alias("head"), body.alias("body")).withColumn("turn", F.concat("head", "body", F.lit("</turn>\n")))
    before = Window.partitionBy("c", "path").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.length("head")
    span = F.when(F.col("role") == ASSISTANT, F.struct(start.cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    parts = shown.select("c", "path", "depth", "turn", span.alias("span")).groupBy("c", "path").agg(F.sort_array(F.collect_list(F.struct("depth", "turn", "span"))).alias("parts"))
    return parts.select(F.col("c.conv").alias("conv"), "path", F.array_join(F.col("parts.turn"), "").alias("formatted"), F.filter(F.col("parts.span"), lambda s: s.isNotNull()).alias("loss_mask"))


def read_back(chats: DataFrame) -> DataFrame:
    """Append turns (array of role, text) parsed from the formatted text, and loss_text, the unescaped texts under the mask."""
    found = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(0))
    turns = F.transform(found, lambda t: F.struct(unescape(F.regexp_extract(t, TURN, 1)).alias("role"), unescape(F.regexp_extract(t, TURN, 2)).alias("text")))
    under = F.transform("loss_mask", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return chats.withColumn("turns", turns).withColumn("loss_text", F.array_join(under, ""))
