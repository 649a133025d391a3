"""Registered queries over the operators for training data. Each derives its columns from the operator's own output."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmarts import lineage
from tripmarts.llm import bpe, chat, decontaminate, filter_audit, infill, packing, pii, quality, search, simhash, token_counts, token_files, toxicity
from tripmarts.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The end id that each document gets in token files.
END_ID = 2


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.decode(bpe.encode(read_table(spark, sf_dir, "documents", "doc_id", "text"), path), path)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "item_id", "edits", "passages", F.col("end").alias("end_at"))


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    counts = [F.size(F.filter(F.col("base.kind"), lambda k: k == i)).cast("long").alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = F.lit(r"\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    tree = chat.rows_in_order(rows.unionByName(extra), "conv_id", "turn", "role", "text")
    back = chat.read_back(chat.format_chats(tree))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(F.col("conv").cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLES["op6_chat"] = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) AS r(t)),
turns AS (
  SELECT *, length('### : </turn>') + 1 + length(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g'))
    + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) AS shown
  FROM said)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
  CAST(sum(shown) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "labels", "doc_id", "quality"), folds=3, held_out=1, threshold=0.5)


#: Results for each query of op8.
TOP = 10


@query
def op8_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return search.top_k(docs, docs.where("doc_id % 100 = 0"), TOP)


ORACLES["op8_search"] = rf"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
size AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id),
n AS (SELECT count(*) AS n, (SELECT sum(dl) FROM size) / CAST(count(*) AS DOUBLE) AS mean FROM documents),
idf AS (SELECT term, ln(1 + (any_value(n.n) - count(*) + CAST(0.5 AS DOUBLE)) / (count(*) + CAST(0.5 AS DOUBLE))) AS idf FROM tf, n GROUP BY term),
impact AS (
  SELECT tf.doc_id, term, CAST(floor(idf * (CAST(tf AS DOUBLE) * CAST({search.K1 + 1} AS DOUBLE)
    / (tf + CAST({search.K1} AS DOUBLE) * (CAST({1 - search.B} AS DOUBLE) + CAST({search.B} AS DOUBLE) * dl / mean))) * {search.UNIT} + CAST(0.5 AS DOUBLE)) AS BIGINT) AS units
  FROM tf JOIN size USING (doc_id) JOIN idf USING (term), n),
scores AS (
  SELECT q.doc_id AS query_id, i.doc_id, CAST(sum(units) AS BIGINT) AS units
  FROM tf AS q JOIN impact AS i USING (term) WHERE q.doc_id % 100 = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY units DESC, doc_id) AS rank FROM scores)
SELECT query_id, rank, doc_id, units / CAST({search.UNIT} AS DOUBLE) AS score FROM ranked WHERE rank <= {TOP}"""


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    manifest = token_files.write_tokens(docs, lineage.shared_folder(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_files.read_tokens(manifest).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "labels", "doc_id", "toxic"), folds=4, held_out=2, threshold=0.3)


@query
def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.infill(read_table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "infill.*")
    cut = infill.parts(F.col("output"), F.col("form"))
    read = made.select("doc_id", "n", "form", "output", F.length(cut["prefix"]).cast("long").alias("prefix_chars"), F.length(cut["middle"]).cast("long").alias("middle_chars"),
                       infill.restored(F.col("output"), F.col("form")).alias("restored"))
    return read.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLES["op11_infill"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
draws AS (SELECT *, len(units) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS r FROM d),
cuts AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 THEN 'plain'
      WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM draws),
three AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM three"""


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    pieces = packing.pack(docs, lineage.shared_folder(spark, "packing"), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang"), read_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


ORACLES["op13_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
f AS (
  SELECT doc_id, part, [CASE WHEN len(words) < 100 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' END,
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > first_id THEN 'E' END] AS marks,
    coalesce(quality, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d JOIN firsts USING (text) LEFT JOIN labels USING (doc_id)),
fails AS (SELECT part, list_filter(marks, lambda m: m IS NOT NULL) AS failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || e.x || g.x AS filter_order FROM letters a, letters b, letters c, letters e, letters g
  WHERE len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5),
places AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS x, string_split(substr(filter_order, 1, step - 1), '') AS before FROM orders, range(1, 6) AS r(step)),
cells AS (
  SELECT part, filter_order, step, x,
    sum(CASE WHEN list_has_any(failed, before) OR list_contains(failed, x) THEN 0 ELSE n END) AS kept,
    sum(CASE WHEN list_contains(failed, x) AND NOT list_has_any(failed, before) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN list_contains(failed, x) AND list_has_any(failed, before) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = [x] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN list_contains(failed, x) AND NOT list_has_any(failed, before) THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN list_contains(failed, x) AND NOT list_has_any(failed, before) THEN toxic ELSE 0 END) AS toxic_lost
  FROM fails, places GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM cells"""
