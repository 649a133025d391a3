"""Token ids in seekable binary files: independent zstandard frames, a trailing seek table, a checksum per frame.

Layout of a file (integers little-endian):

* zstandard frames, each with whole documents: u32 number of documents, u32 bytes per token, then per document u8 (1: it has an id),
  i64 id, u32 tokens, then the tokens of all of them in order.
* a skippable frame (0x184D2A50) with the index of documents: per frame i64 least id, i64 largest id, u64 tokens before it, u32 documents
  (frames without any id have the least i64 as both).
* the seek table of the public seekable format, a skippable frame (0x184D2A5E): per frame u32 compressed size, u32 size, u32 checksum
  (low half of XXH64 of the content); then u32 frames, u8 0x80 (checksums are there), u32 0x8F92EAB1.

A reader takes the table from the end of the file, decompresses only the frames whose id range meets the request, and checks them.
Any zstandard tool can unpack the whole file.

Documents are range-partitioned by (id, hash of the text), so a repeated id can be split, sorted inside their task and written as
one file per task (a new one after file_bytes). The manifest, one row a file, is checkpointed; its file names are unique to the
attempt that wrote them, so files of lost or repeated attempts are never read. Prefix sums over the manifest give each file's
first token; nothing larger is ordered in one place.

Rows without id come first, then ascending ids; rows that share an id are ordered by hash of the text and then by text. Null texts
are empty (only the end id). An empty table gives an empty manifest. Other columns are not read.
"""

from __future__ import annotations

import re
import struct
import uuid
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tripmarts import lineage
from tripmarts.llm.common import id_and_text, slices
from tripmarts.llm.word_ids import word_ids

FRAME_BYTES = 1 << 20
FILE_BYTES = 256 << 20
INDEX_MAGIC, TABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
NO_ID = -(1 << 63)

MANIFEST = StructType([StructField("part", LongType()), StructField("seq", LongType()), StructField("file", StringType()),
                       StructField("documents", LongType()), StructField("tokens", LongType()), StructField("bytes", LongType())])


def file_system(uri: str):
    """The Arrow file system and the path for a folder or file of the cluster's shared store."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)


class TokenWriter:
    """Writes documents, given in order, to one file; holds no more than a frame and the table."""

    def __init__(self, uri: str, width: int, frame_bytes: int = FRAME_BYTES):
        import zstandard

        store, path = file_system(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.width, self.frame_bytes = store.open_output_stream(path, compression=None), width, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=3)
        self.table: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []
        self.documents = self.tokens = self.before = self.size = 0
        self._clear()

    def _clear(self) -> None:
        self.ids: list[int | None] = []
        self.data: list[bytes] = []
        self.held = 0

    def add(self, doc_id: int | None, tokens: bytes) -> None:
        self.ids.append(doc_id)
        self.data.append(tokens)
        self.held += len(tokens)
        self.documents += 1
        self.tokens += len(tokens) // self.width
        if self.held >= self.frame_bytes:
            self._frame()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _frame(self) -> None:
        import xxhash

        if not self.ids:
            return
        n = len(self.ids)
        has = [x is not None for x in self.ids]
        content = b"".join([struct.pack("<II", n, self.width), bytes(has), array("q", [x if x is not None else 0 for x in self.ids]).tobytes(),
                            array("I", [len(x) // self.width for x in self.data]).tobytes(), *self.data])
        packed = self.zstd.compress(content)
        self._write(packed)
        self.table.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        real = [x for x in self.ids if x is not None]
        self.index.append((min(real, default=NO_ID), max(real, default=NO_ID), self.before, n))
        self.before = self.tokens
        self._clear()

    def close(self) -> None:
        self._frame()
        index = b"".join(struct.pack("<qqQI", *x) for x in self.index)
        self._write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.table)
        self._write(struct.pack("<II", TABLE_MAGIC, len(table) + 9) + table + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE_MAGIC))
        self.out.close()


class TokenFile:
    """Random access to a file: reads its end first, then only the frames that are asked for."""

    def __init__(self, uri: str):
        store, path = file_system(uri)
        self.file = store.open_input_file(path)
        end = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUMS:
            raise ValueError(f"{uri} is no token file")
        at = end - 9 - 12 * frames - 8
        tag, size = struct.unpack("<II", self._at(at, 8))
        if tag != TABLE_MAGIC or size != 12 * frames + 9:
            raise ValueError(f"{uri}: damaged seek table")
        self.table = list(struct.iter_unpack("<III", self._at(at + 8, 12 * frames)))
        index = self._at(at - 28 * frames - 8, 28 * frames + 8)
        if struct.unpack("<II", index[:8]) != (INDEX_MAGIC, 28 * frames):
            raise ValueError(f"{uri}: damaged index")
        self.index = list(struct.iter_unpack("<qqQI", index[8:]))
        self.offsets = [0]
        for packed, _, _ in self.table:
            self.offsets.append(self.offsets[-1] + packed)

    def _at(self, offset: int, size: int) -> bytes:
        return self.file.read_at(size, offset) if size else b""

    def frame(self, i: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, tokens before the document in this file, its tokens) of each document of a frame."""
        import xxhash
        import zstandard

        packed, size, checksum = self.table[i]
        content = zstandard.ZstdDecompressor().decompress(self._at(self.offsets[i], packed), max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {i} is damaged")
        n, width = struct.unpack_from("<II", content)
        has = content[8:8 + n]
        ids = np.frombuffer(content, "<i8", n, 8 + n)
        counts = np.frombuffer(content, "<u4", n, 8 + 9 * n)
        tokens = np.frombuffer(content, f"<u{width}", offset=8 + 13 * n)
        ends = np.cumsum(counts, dtype=np.int64)
        for k in range(n):
            start = int(ends[k] - counts[k])
            yield int(ids[k]) if has[k] else None, self.index[i][2] + start, tokens[start:int(ends[k])]

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        for i in range(len(self.table)):
            yield from self.frame(i)

    def documents(self, wanted: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """The documents with these ids; no other frame than theirs is read."""
        want = sorted(set(wanted))
        for i, (low, high, _, _) in enumerate(self.index):
            k = bisect_left(want, low)
            if high != NO_ID and k < len(want) and want[k] <= high:
                for doc_id, _, tokens in self.frame(i):
                    if doc_id is not None and (at := bisect_left(want, doc_id)) < len(want) and want[at] == doc_id:
                        yield doc_id, tokens


def _writer(folder: str, path: str, end_id: int, frame_bytes: int, file_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, seq, out, name = word_ids(path), TaskContext.get().partitionId(), 0, None, ""
        end = bpe.dtype(end_id).tobytes()

        def finished() -> pa.RecordBatch:
            out.close()
            row = (part, seq, name, out.documents, out.tokens, out.size)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=MANIFEST.names)

        for batch in slices(batches):
            doc_ids = iter(batch.column(0).to_pylist())
            for n, ids, counts in bpe.encode(batch.column(1).cast(pa.string())):
                ends = np.cumsum(counts)
                for doc_id, first, last in zip(islice(doc_ids, n), (ends - counts).tolist(), ends.tolist(), strict=True):
                    if out is None:
                        name = f"{folder}/{part:06d}-{seq:04d}-{uuid.uuid4().hex[:12]}.tokens"
                        out = TokenWriter(name, bpe.dtype().itemsize, frame_bytes)
                    out.add(doc_id, ids[first:last].tobytes() + end)
                    if out.size >= file_bytes:
                        yield finished()
                        out, seq = None, seq + 1
        if out is not None:
            yield finished()
    return run


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                 frame_bytes: int = FRAME_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode and write all of docs; the manifest: file, documents, tokens, bytes, and start (tokens in all files before it)."""
    rows = id_and_text(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), "text_").withColumn("tie", F.xxhash64("text_"))
    order = [F.col("id").asc_nulls_first(), F.col("tie"), F.col("text_")]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order).select("id", "text_")
    manifest = lineage.cut(dealt.mapInArrow(_writer(folder, path, end_id, frame_bytes, file_bytes), MANIFEST))
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))


READ = StructType([StructField("id", LongType()), StructField("start", LongType()), StructField("n_tokens", LongType()), StructField("ids", BinaryType())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        ids, starts, tokens = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array([len(t) for t in tokens], pa.int64()),
                                           pa.array([t.astype("<u4").tobytes() for t in tokens], pa.binary())], names=READ.names)

    for b in batches:
        for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            file = TokenFile(name)
            for i in range(len(file.table)):
                yield batch_of([(doc_id, base + start, tokens) for doc_id, start, tokens in file.frame(i)])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """All documents of the files: id, start (tokens of all documents before it), n_tokens, ids (unsigned 32-bit integers)."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "start").repartition(n).mapInArrow(_read, READ)
