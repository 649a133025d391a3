r"""Audit of filters that are applied in a row: what each step of each order removes, what it finds gone, and which labels it loses.

1. One pass over the texts gives each row a 64-bit key and the outcome of each filter (Parquet in the shared folder, so keys stay as they are).
2. One table of failing keys per filter is stored, with part and labels of the row.
3. What is left after some filters doesn't depend on their order, so there are 2^k prefixes, not k!. Relations over (key, prefix) hold all
   prefixes at once: survivors are all keys left-anti the failing keys of a prefix's filters; removals of a filter are its failing keys left-semi
   the survivors of each prefix without it, redundancies the same failing keys left-anti these survivors. Labels lost are summed over removals.
4. The counts per part, prefix and filter are put together for all orders. Shapley values add the removals after each prefix times the number
   of orders that start with it.

Keys are unique, so no join has a hot key. Rows of the joins are narrow: 2^k rows of a key, a mask and a part for each document.

The filter for identical texts needs the least id per text: least ids are taken per (text, salt), then per text, and go back to each salt of the
text, so a text that a third of all rows share is spread over SALTS tasks. Texts are told apart by 256-bit hashes.

Null texts are empty, a null part is the empty string, null ids have no smaller id and no label. Repeated rows count each. A label other than 1
is no label; an id with several label rows has the largest. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField

from tripmarts import lineage
from tripmarts.llm.common import map_columns

#: A hot text is spread over so many tasks.
SALTS = 64
DUPLICATE = "duplicate"
#: Counts of a text that filters look at, and its hash.
COUNTS = ["n_chars", "n_words", "n_distinct", "n_capitals", "n_signs"]
CAPITALS, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"


def rules(min_words: int = 100, least_distinct: int = 80, most_capitals: int = 10) -> dict[str, Column | str]:
    """The failing condition of each filter on COUNTS, or DUPLICATE; percentages are compared as integers."""
    return {"A": F.col("n_words") < min_words, "B": F.col("n_distinct") * 100 < F.col("n_words") * least_distinct,
            "C": F.col("n_capitals") * 100 > F.col("n_chars") * most_capitals, "D": F.col("n_signs") > 0, "E": DUPLICATE}


def _counter() -> Callable[[list[str]], list[pa.Array]]:
    def count(text: str) -> tuple[int, ...]:
        data = text.encode()
        words = data.split()
        return len(text), len(words), len(set(words)), len(data) - len(data.translate(None, CAPITALS)), len(data) - len(data.translate(None, SIGNS))

    def work(texts: list[str]) -> list[pa.Array]:
        counts = [count(t) for t in texts]
        digests = pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())
        return [*(pa.array(c, pa.int64()) for c in zip(*counts, strict=True)), digests] if counts else [*(pa.array([], pa.int64()) for _ in COUNTS), digests]
    return work


def outcomes(docs: DataFrame, filters: dict[str, Column | str], id_col: str, text_col: str, part_col: str) -> DataFrame:
    """key, id, part, digest (of the text) and one boolean column per filter that looks at the text alone."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    counted = map_columns(rows, "text", _counter, [*(StructField(c, LongType()) for c in COUNTS), StructField("digest", BinaryType())], drop_text=True)
    fails = [F.coalesce(c, F.lit(False)).alias(f"fails_{f}") for f, c in filters.items() if not isinstance(c, str)]
    return counted.select(F.monotonically_increasing_id().alias("key"), "id", "part", "digest", *fails)


def later_copies(rows: DataFrame) -> DataFrame:
    """The keys of rows whose text is that of a row with a smaller id."""
    salted = rows.where("id IS NOT NULL").select("key", "digest", "id", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    least = salted.groupBy("digest", "salt").agg(F.min("id").alias("id")).groupBy("digest").agg(F.min("id").alias("least"), F.collect_list("salt").alias("salts"))
    back = least.select("digest", "least", F.explode("salts").alias("salt"))
    return salted.join(back, ["digest", "salt"]).where("id > least").select("key")


def labels_of(keys: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """good and toxic (1 or 0) for the rows whose id has a label row."""
    marks = labels.where(labels[id_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg(
        *[F.max(F.when(labels[c] == 1, 1).otherwise(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    return keys.select("key", "id").join(marks, "id").select("key", "good", "toxic")


def store_failing(rows: DataFrame, labels: DataFrame, filters: dict[str, Column | str], id_col: str, folder: str) -> dict[str, DataFrame]:
    """One stored table of failing keys per filter: key, part, good, toxic."""
    spark = rows.sparkSession
    labels_of(rows, labels, id_col).write.parquet(f"{folder}/labels")
    marked = spark.read.parquet(f"{folder}/labels")
    for name, condition in filters.items():
        failed = rows.join(later_copies(rows), "key", "left_semi") if isinstance(condition, str) else rows.where(f"fails_{name}")
        known = failed.select("key", "part").join(marked, "key", "left")
        known.select("key", "part", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]).write.parquet(f"{folder}/failing/{name}")
    return {name: spark.read.parquet(f"{folder}/failing/{name}") for name in filters}


def steps(rows: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """(part, prefix, filter, kept, removed, redundant, good_lost, toxic_lost); prefix as a bit mask, filter -1 for what the prefix keeps."""
    k = len(failing)
    masks = list(range(1 << k))

    def at_prefixes(i: int, name: str, inside: bool) -> DataFrame:
        wanted = F.array(*[F.lit(m).cast("short") for m in masks if bool(m >> i & 1) == inside])
        return failing[name].select("*", F.lit(i).alias("filter"), F.explode(wanted).alias("prefix"))

    gone = reduce(DataFrame.unionByName, [at_prefixes(i, name, True).select("key", "prefix") for i, name in enumerate(failing)])
    tried = reduce(DataFrame.unionByName, [at_prefixes(i, name, False) for i, name in enumerate(failing)])
    everything = rows.select("key", "part", F.explode(F.array(*[F.lit(m).cast("short") for m in masks])).alias("prefix"))
    alive = everything.join(gone.hint("merge"), ["key", "prefix"], "left_anti")
    removed = tried.join(alive.hint("merge"), ["key", "prefix"], "left_semi")
    redundant = tried.join(alive.hint("merge"), ["key", "prefix"], "left_anti")

    def counted(df: DataFrame, filter_: Column, **sums: Column) -> DataFrame:
        values = [sums.get(c, F.lit(0)).cast("long").alias(c) for c in ("kept", "removed", "redundant", "good_lost", "toxic_lost")]
        return df.groupBy("part", "prefix", filter_.alias("filter")).agg(*values)

    n = F.count(F.lit(1))
    found = counted(alive, F.lit(-1), kept=n).unionByName(counted(removed, F.col("filter"), removed=n, good_lost=F.sum("good"), toxic_lost=F.sum("toxic")))
    found = found.unionByName(counted(redundant, F.col("filter"), redundant=n))
    return found.groupBy("part", "prefix", "filter").agg(*[F.sum(c).alias(c) for c in ("kept", "removed", "redundant", "good_lost", "toxic_lost")])


def by_order(stats: DataFrame, names: list[str]) -> DataFrame:
    """The counts of prefixes laid out for all orders, with zeros for cells without documents."""
    spark, k = stats.sparkSession, len(names)
    parts = stats.where("prefix = 0 AND filter = -1").select("part")
    grid = parts.select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << k) - 1))).alias("prefix")).select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("filter"))
    grid = grid.where("(prefix & shiftleft(1, filter)) = 0").withColumn("after", F.expr("prefix | shiftleft(1, filter)"))
    kept = stats.where("filter = -1").select("part", F.col("prefix").cast("int").alias("after"), "kept")
    counts = ["removed", "redundant", "good_lost", "toxic_lost"]
    cells = grid.join(stats.select("part", F.col("prefix").cast("int").alias("prefix"), "filter", *counts), ["part", "prefix", "filter"], "left").join(kept, ["part", "after"], "left")
    cells = cells.select("part", "prefix", "filter", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ["kept", *counts]])
    size = F.bit_count("prefix")
    orders = reduce(lambda c, s: c.when(size == s, factorial(s) * factorial(k - 1 - s)), range(1, k), F.when(size == 0, factorial(k - 1)))
    alone = F.max(F.when(size == k - 1, F.col("removed"))).alias("unique_fails")
    whole = cells.groupBy("part", "filter").agg(alone, F.sum(F.col("removed") * orders).alias("shapley"))
    # the layout of the orders: k! times k rows, whatever the data
    places = [("".join(names[i] for i in o), s + 1, o[s], sum(1 << i for i in o[:s])) for o in permutations(range(k)) for s in range(k)]
    layout = spark.createDataFrame(places, "filter_order string, step int, filter int, prefix int")
    laid = layout.join(cells, ["filter", "prefix"]).join(whole, ["part", "filter"])
    return laid.select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | str] | None = None, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step, with counts of documents as described above."""
    spark, filters = docs.sparkSession, filters or rules()
    folder = lineage.shared_folder(spark, "filter-audit")
    outcomes(docs, filters, id_col, text_col, part_col).write.parquet(f"{folder}/outcomes")
    rows = spark.read.parquet(f"{folder}/outcomes")
    failing = store_failing(rows, labels, filters, id_col, folder)
    return by_order(lineage.cut(steps(rows, failing)), list(filters))
