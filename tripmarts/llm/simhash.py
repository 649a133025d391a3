"""SimHash near-duplicates: fingerprints, links by multi-index hashing, connected components.

Fingerprint: words between ASCII white space, lower-cased A-Z, shingles of `width` words with repeats (fewer words: all of them; none:
zero); XXH64 with seed 42 of each; a bit is set if it is set in more than half of the hashes.

Links: two fingerprints that differ in at most 2 bits differ from some common value in at most 1 bit each. A fingerprint is two
segments of 32 bits. For each, the Hamming ball of radius 1 within the segment is enumerated, the other segment stays as it is and
is part of the table's key (65 keys for a fingerprint: itself and 32 of each segment). Fingerprints with a key in common are fetched
and their whole distance is verified. With whole keys no bucket is hot: at most 65 fingerprints can share a key, however many
documents or near copies there are, and a bucket is joined to its least member, so links grow with fingerprints, not with
pairs. Equal fingerprints are one node from the start.

Components: links are rewired to smaller neighbours (large star and small star in turn) until nothing changes; each round is
checkpointed to the shared folder. Distances are verified per link, components are the exact closure of all links.

Null texts are empty, empty texts have fingerprint zero and are linked like any other, repeated rows stay repeated and share their
component. A null id keeps a null doc_id and takes part; a component id is its least non-null id (null if it has none). An
empty table gives no rows. Other columns are not read by `near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from tripmarts import lineage
from tripmarts.llm.common import id_and_text, map_columns

SEED = 42
WIDTH = 3
HASHES_AT_ONCE = 1 << 16


def shingle_hashes(text: bytes, width: int = WIDTH) -> list[int]:
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return []
    if len(words) <= width:
        return [xxh64_intdigest(b" ".join(words), SEED)]
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[: len(words) - width + 1].tolist()
    return [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1:].tolist(), strict=True)]


def fingerprints(texts: list[bytes], width: int = WIDTH) -> np.ndarray:
    """One unsigned 64-bit fingerprint a text; bits are counted in blocks of bounded size."""
    out = np.zeros(len(texts), np.uint64)
    held: list[int] = []
    owner: list[tuple[int, int]] = []
    counts = np.zeros((len(texts), 64), np.int64)
    totals = np.zeros(len(texts), np.int64)

    def count() -> None:
        if not held:
            return
        bits = np.unpackbits(np.array(held, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begins = np.cumsum([0] + [n for _, n in owner[:-1]])
        counts[[k for k, _ in owner]] += np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
        held.clear()
        owner.clear()

    for k, text in enumerate(texts):
        hashes = shingle_hashes(text, width)
        totals[k] = len(hashes)
        for at in range(0, len(hashes), HASHES_AT_ONCE):
            block = hashes[at:at + HASHES_AT_ONCE]
            if owner and owner[-1][0] == k:
                count()
            held += block
            owner.append((k, len(block)))
            if len(held) >= HASHES_AT_ONCE:
                count()
    count()
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    out[:] = ((counts * 2 > totals[:, None]).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
    return out


def _fingerprinter(width: int) -> Callable[[], Callable[[list[str]], list[pa.Array]]]:
    def make():
        def work(texts: list[str]) -> list[pa.Array]:
            return [pa.array(fingerprints([t.encode() for t in texts], width).view(np.int64))]
        return work
    return make


def with_fingerprint(docs: DataFrame, text_col: str, out_col: str, width: int = WIDTH, drop_text: bool = False) -> DataFrame:
    """Append the fingerprint as a signed 64-bit integer."""
    return map_columns(docs, text_col, _fingerprinter(width), [StructField(out_col, LongType())], drop_text)


def links(prints: DataFrame, col: str = "fp") -> DataFrame:
    """(a, b): links between distinct fingerprints at 2 or fewer bits, enough of them to keep every connection."""
    flips = [(1 << bit) - (1 << 64 if bit == 63 else 0) for segment in (0, 32) for bit in range(segment, segment + 32)]
    balls = F.array(F.col(col), *[F.col(col).bitwiseXOR(F.lit(m).cast("long")) for m in flips])
    probes = prints.select(F.col(col).alias("b"), F.explode(balls).alias("key"))
    found = probes.withColumn("a", F.lag("b").over(Window.partitionBy("key").orderBy("b"))).where("a IS NOT NULL")
    return found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node of its component."""
    both = edges.select("a", "b").where("a != b")
    state = lineage.cut(both.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    while True:
        # large star: every larger neighbour takes the least of v and its neighbours
        sided = state.select("v", "u").unionByName(state.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = sided.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("m"))
        large = sided.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # small star: v and every smaller neighbour take the least of these
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u < v")
        after = lineage.cut(small.unionByName(low.select("v", F.col("m").alias("u"))).distinct())
        if after.count() == state.count() and after.join(state, ["v", "u"], "left_anti").isEmpty():
            break
        state = after
    return state.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(state.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def classes(marked: DataFrame) -> DataFrame:
    """From (id, tie, fp) rows: fp and `least`, the least (no id, id, tie) of its component, for each distinct fingerprint."""
    row = F.struct(F.col("id").isNull().alias("no_id"), "id", "tie")
    nodes = lineage.cut(marked.groupBy("fp").agg(F.min(row).alias("least")))
    joined = nodes.join(components(links(nodes)), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = joined.groupBy("root").agg(F.min("least").alias("least"))
    return joined.select("fp", "root").join(ids, "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per row of docs: id, fp (signed 64-bit), component_id."""
    slim = with_fingerprint(id_and_text(docs, id_col, text_col), "text_", "fp", width, drop_text=True).toDF("id", "fp")
    slim = lineage.cut(slim.withColumn("tie", F.lit(0)))
    found = slim.select("id", "fp").join(classes(slim).select("fp", F.col("least.id").alias("component_id")), "fp")
    return found.select(F.col("id").alias(id_col), "fp", "component_id")


def row_of_each(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The least row of docs for each row (id, tie) of kept, with all its columns; tie is the text's hash.

    Repeats of a row are combined inside the map tasks, so a row that fills a third of the table does not meet in one task.
    """
    hashed = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    rows = docs.select(docs[id_col].alias("id"), hashed.alias("tie"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    one = rows.groupBy("id", "tie").agg(F.min("row").alias("row"))
    same = one["id"].eqNullSafe(kept["id"]) & (one["tie"] == kept["tie"])
    return one.join(kept, same, "left_semi").select("row.*")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row of docs for each component, with all its columns: least id (rows without id last), then least text hash, then least row."""
    slim = id_and_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text_"))
    slim = lineage.cut(with_fingerprint(slim, "text_", "fp", width, drop_text=True).toDF("id", "tie", "fp"))
    return row_of_each(docs, classes(slim).select("least.*").distinct(), id_col, text_col)
