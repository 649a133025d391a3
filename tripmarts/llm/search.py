"""Exact BM25 top-k by an inverted index per shard with block-max pruning, merged with global statistics.

Terms are runs of letters and digits, lower-cased. A posting's impact is idf(term) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean
length)), rounded to 1/UNIT; a score is the sum of the impacts of the distinct terms of the query. Impacts are whole numbers of UNITs,
so sums don't depend on their order, equal texts have equal scores, and shards merge exactly. Ties go to the least id (no id last).

* A shard is what one task reads, at most SHARD_DOCS documents at a time: postings by term, in document order. Shards are files in
  the shared folder, their manifest is checkpointed, so a lost executor only loses what it was writing.
* Document frequencies are summed over all shards and joined to the terms of the queries; queries are stored in files of bounded
  size. A shard and a few query files are one task's work. Neither queries nor terms pass through the driver or a broadcast.
* Within a shard, block-max WAND for all documents at once: rare terms are added up; the k best of these, scored in full, give the
  threshold. Terms whose largest impacts together stay below it can't bring in a document alone and aren't read through; others
  are added up too. For a document, what the unread terms can add is bounded by their largest impact in its block of BLOCK documents.
  Only documents whose bound reaches the threshold are scored in full. Nothing else could be among the k best.

Of queries that share an id the least text counts; a null id isn't a query. Null texts are empty; documents without a common term aren't
results, so an empty query has none. Repeated documents are results each. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import io
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tripmarts import lineage
from tripmarts.llm.common import SLICE_ROWS, id_and_text, slices
from tripmarts.llm.token_files import file_system

K1, B, UNIT = 1.2, 0.75, 65536
BLOCK = 64
SHARD_DOCS, SHARD_CHARS = 16_384, 1 << 26
#: Queries of a file at most, and files that one task takes.
QUERY_ROWS, QUERY_FILES = 4096, 4
#: Terms in at most this share of a shard's documents are added up at once.
RARE = 1 / 16
TERM = re.compile(r"[^\W_]+")

SHARD = StructType([StructField("file", StringType()), StructField("documents", LongType()), StructField("terms", LongType())])
FOUND = StructType([StructField("query", LongType()), StructField("doc", LongType()), StructField("units", LongType())])


def terms_of(text: str) -> list[str]:
    return TERM.findall(text.lower())


def _store(uri: str, arrays: dict[str, np.ndarray]) -> None:
    import zstandard

    data = io.BytesIO()
    np.savez(data, **arrays)
    store, path = file_system(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        out.write(zstandard.ZstdCompressor(level=1).compress(data.getvalue()))


def _load(uri: str) -> dict[str, np.ndarray]:
    import zstandard

    store, path = file_system(uri)
    with store.open_input_file(path) as f:
        with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(f.read()))) as data:
            return {k: data[k] for k in data.files}


class Builder:
    """Collects the documents of a shard."""

    def __init__(self) -> None:
        self.vocabulary: dict[str, int] = {}
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_id: int | None, text: str) -> None:
        counts = Counter(terms_of(text))
        numbers = self.vocabulary
        self.terms.append(np.fromiter((numbers.setdefault(t, len(numbers)) for t in counts), np.int32, len(counts)))
        self.counts.append(np.fromiter(counts.values(), np.int32, len(counts)))
        self.ids.append(doc_id)
        self.lengths.append(int(self.counts[-1].sum()))
        self.chars += len(text)

    def arrays(self) -> dict[str, np.ndarray]:
        term = np.concatenate(self.terms) if self.terms else np.zeros(0, np.int32)
        doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), [len(t) for t in self.terms])
        order = np.argsort(term, kind="stable")
        return {"vocabulary": np.frombuffer("\n".join(self.vocabulary).encode(), np.uint8), "first": np.append(0, np.cumsum(np.bincount(term, minlength=len(self.vocabulary)))),
                "doc": doc[order], "tf": (np.concatenate(self.counts) if self.counts else np.zeros(0, np.int32))[order], "length": np.array(self.lengths, np.int32),
                "id": np.array([0 if i is None else i for i in self.ids], np.int64), "no_id": np.array([i is None for i in self.ids], bool)}


class Shard:
    """An index ready to search for the terms of a query file, which are named by their place in `terms`.

    df: document frequencies of the terms; documents, mean: global number of documents and mean length.
    """

    def __init__(self, arrays: dict[str, np.ndarray], terms: pa.Array, df: np.ndarray, documents: int, mean: float):
        words = arrays["vocabulary"].tobytes().decode()
        vocabulary = pa.array(words.split("\n") if words else [], pa.string())
        self.number = pc.fill_null(pc.index_in(terms, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.first, self.doc = arrays["first"].astype(np.int64), arrays["doc"]
        self.ids, self.no_id, self.size = arrays["id"], arrays["no_id"], len(arrays["id"])
        n, sizes = len(vocabulary), np.diff(self.first)
        asked = self.number >= 0
        idf = np.zeros(n)
        idf[self.number[asked]] = np.log(1 + (documents - df[asked] + 0.5) / (df[asked] + 0.5))
        tf = arrays["tf"].astype(np.float64)
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * arrays["length"] / max(mean, 1e-9))[self.doc])
        del tf
        self.impact = np.floor(np.repeat(idf, sizes) * part * UNIT + 0.5)
        del part
        self.top = np.maximum.reduceat(self.impact, self.first[:-1]) if n else np.zeros(0)
        # terms that many documents have, of these queries: a row of impacts each, and the largest of each block of documents
        common = np.flatnonzero((sizes > max(1.0, self.size * RARE)) & (idf > 0))
        self.row = np.full(n, -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.size), np.int32)
        for r, i in enumerate(common.tolist()):
            a, b = self.first[i], self.first[i + 1]
            self.rows[r, self.doc[a:b]] = self.impact[a:b]
        self.tops = np.maximum.reduceat(self.rows, np.arange(0, self.size, BLOCK), axis=1) if self.size else self.rows
        self.largest = self.top[common]

    def search(self, terms: np.ndarray, k: int) -> list[tuple[int | None, int]]:
        """The k best (id, units) for the distinct terms of a query."""
        known = self.number[terms]
        known = known[known >= 0]
        if not len(known):
            return []
        rows = self.row[known]
        rare, rest = known[rows < 0], rows[rows >= 0]
        start, n = self.first[rare], self.first[rare + 1] - self.first[rare]
        ends = np.cumsum(n)
        at = np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        total = np.bincount(self.doc[at], self.impact[at], self.size)

        def full(docs: np.ndarray) -> np.ndarray:
            return total[docs] + self.rows[np.ix_(rest, docs)].sum(axis=0, dtype=np.int64)

        # the k best by rare terms, scored in full, give a threshold
        least = 0.0
        if len(rare) and self.size > k:
            best = np.argpartition(-total, k - 1)[:k]
            least = float(full(best).min()) if total[best].min() > 0 else 0.0
        # common terms that together stay below it are left unread, the ones with the smallest impacts first
        rest = rest[np.argsort(self.largest[rest], kind="stable")]
        unread = int(np.searchsorted(np.cumsum(self.largest[rest]), least, "left"))
        total = total + self.rows[rest[unread:]].sum(axis=0, dtype=np.int64)
        rest = rest[:unread]
        # a block in which even the largest impacts stay below is out, then a document
        reach = total + np.repeat(self.tops[rest].sum(axis=0, dtype=np.int64), BLOCK)[: self.size]
        docs = np.flatnonzero((reach >= least) & (total > 0))
        scores = full(docs)
        if len(docs) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            docs, scores = docs[scores >= least], scores[scores >= least]
        order = np.lexsort((self.ids[docs], self.no_id[docs], -scores))[:k]
        return [(None if self.no_id[d] else int(self.ids[d]), int(s)) for d, s in zip(docs[order].tolist(), scores[order].tolist(), strict=True)]


def _build(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = Builder()

        def finished() -> pa.RecordBatch:
            name = f"{folder}/{uuid.uuid4().hex}.shard"
            _store(name, built.arrays())
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, len(built.ids), sum(built.lengths))], names=SHARD.names)

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                built.add(doc_id, text)
                if len(built.ids) >= SHARD_DOCS or built.chars >= SHARD_CHARS:
                    yield finished()
                    built = Builder()
        if built.ids:
            yield finished()
    return run


FREQUENCY = StructType([StructField("term", StringType()), StructField("df", LongType())])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name in batch.column(0).to_pylist():
            a = _load(name)
            words = a["vocabulary"].tobytes().decode()
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(words.split("\n")), pa.array(np.diff(a["first"]))], names=FREQUENCY.names)


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [sorted(set(terms_of(t))) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.string()))], names=["query", "terms"])


def _search(k: int, documents: int, mean: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (shard file, query files): each query file against the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            for name, files in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                arrays = _load(name)
                for queries in files:
                    store, path = file_system(queries)
                    asked = pq.read_table(path, filesystem=store, columns=["query", "term", "df"])
                    ids = asked.column("query").to_pylist()
                    term, df = (asked.column(c).combine_chunks() for c in ("term", "df"))
                    ends = np.cumsum(pc.list_value_length(term).to_numpy(zero_copy_only=False))
                    coded = term.flatten().dictionary_encode()
                    codes = coded.indices.to_numpy(zero_copy_only=False)
                    frequency = np.zeros(len(coded.dictionary))
                    frequency[codes] = df.flatten().to_numpy(zero_copy_only=False)
                    shard = Shard(arrays, coded.dictionary, frequency, documents, mean)
                    starts = np.append(0, ends[:-1])
                    for at in range(0, len(ids), SLICE_ROWS):
                        part = range(at, min(at + SLICE_ROWS, len(ids)))
                        rows = [(ids[i], doc, units) for i in part for doc, units in shard.search(codes[starts[i]:ends[i]], k)]
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=FOUND.names)
    return run


def top_k(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", query_col: str = "doc_id", query_text_col: str = "text") -> DataFrame:
    """query_id, rank (from 1), id, score: the k best rows of docs for each row of queries."""
    spark = docs.sparkSession
    folder = lineage.shared_folder(spark, "search")
    rows = id_and_text(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), "text_")
    shards = lineage.cut(rows.mapInArrow(_build(folder), SHARD))
    stats = shards.agg(F.sum("documents").alias("n"), F.sum("terms").alias("terms"), F.count("*").alias("shards")).first()
    documents, mean, n = stats["n"] or 0, (stats["terms"] or 0) / max(1, stats["n"] or 0), max(1, stats["shards"])
    df = shards.select("file").repartitionByRange(n, "file").mapInArrow(_frequencies, FREQUENCY).groupBy("term").agg(F.sum("df").alias("df"))
    asked = id_and_text(queries, query_col, query_text_col).select(F.col(query_col).cast("long").alias("query"), "text_").where("query IS NOT NULL").groupBy("query").agg(F.min("text_").alias("text_"))
    terms = asked.mapInArrow(_query_terms, StructType([FOUND["query"], StructField("terms", ArrayType(StringType()))])).select("query", F.explode("terms").alias("term"))
    # both sides grow with the input, whatever the planner guesses of them: no broadcast
    ready = terms.hint("merge").join(df.hint("merge"), "term").groupBy("query").agg(F.collect_list(F.struct("term", "df")).alias("found"))
    ready = lineage.cut(ready.select("query", F.col("found.term").alias("term"), F.col("found.df").alias("df")))
    files = -(-ready.count() // QUERY_ROWS)
    if not files:
        return spark.createDataFrame([], f"query_id bigint, rank bigint, `{id_col}` bigint, score double")
    ready.repartition(files).write.option("maxRecordsPerFile", QUERY_ROWS).parquet(f"{folder}/queries")
    names = sorted(spark.read.parquet(f"{folder}/queries").inputFiles())
    groups = F.array(*[F.array(*[F.lit(f) for f in names[i:i + QUERY_FILES]]) for i in range(0, len(names), QUERY_FILES)])
    work = shards.select("file", F.explode(groups).alias("queries")).repartitionByRange(n * -(-len(names) // QUERY_FILES), "file", "queries")
    found = work.mapInArrow(_search(k, documents, mean), FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("units"), F.col("doc").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), F.col("rank").cast("long").alias("rank"), F.col("doc").alias(id_col), (F.col("units") / UNIT).cast("double").alias("score"))
