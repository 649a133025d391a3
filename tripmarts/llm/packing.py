"""Packing documents into sequences of one size: shortest-pack-first over the histogram of lengths.

1. Tasks encode the documents, append the end id, cut each into pieces of the capacity and one shorter rest, and write the ids to a file per
   task. A piece's rank is its place among the pieces of its length in that file. The manifest, one row a file with its counts per length, is
   checkpointed; files of lost or repeated attempts are in no manifest and are never read.
2. The counts per length of all files, at most one number per length up to the capacity, go to the driver. Lengths are placed longest first,
   each into the pattern of packs with the most room, or into new packs. A pattern is a list of (length, first rank) and a count; only counts
   are changed, so time and size depend on the capacity, not on the number of documents.
3. Where lengths don't fit together (all documents a little over half the capacity), packs would stay partly empty. The shortest packs are taken
   apart as long as their tokens fit into the gaps of LEAST_GAP or more in the others; these pieces are cut at the borders of the gaps.
4. Each file is read again with the number of pieces of each length in the files before it (a window over the manifest), which makes ranks
   global; (length, rank) gives the pattern, and so the sequence and the place in it. Documents are never shuffled.

A pack's documents are only cut by steps 1 and 3. Less than one sequence, and gaps below LEAST_GAP, are left as padding.

Null texts are empty (only the end id), each row is a document of its own, also repeated rows and rows without id. An empty table gives no
rows. Longer texts are encoded in parts; a document's ids are held whole by one task. Other columns are not read. Files are not removed.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from tripmarts import lineage
from tripmarts.llm.common import id_and_text, slices
from tripmarts.llm.token_files import file_system
from tripmarts.llm.word_ids import word_ids

CAPACITY = 4096
#: Smaller gaps stay padding: filling them would cut documents into crumbs.
LEAST_GAP = 64
#: Ranks fit below a length in one 64-bit key.
RANK_BITS = 44

MANIFEST = StructType([StructField("file", StringType()), StructField("counts", ArrayType(LongType()))])
Pattern = tuple[int, int, list[tuple[int, int]]]


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """(packs, room left in each, [(length, rank in its length for the first of the packs)]) for counts of pieces per length."""
    by_room: dict[int, list[Pattern]] = {}
    rooms: list[int] = []

    def put(pattern: Pattern) -> None:
        if pattern[1] not in by_room:
            by_room[pattern[1]] = []
            heapq.heappush(rooms, -pattern[1])
        by_room[pattern[1]].append(pattern)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if not rooms or -rooms[0] < length:
                put((left, capacity - length, [(length, rank)]))
                break
            room = -rooms[0]
            packs, _, pieces = by_room[room].pop()
            if not by_room[room]:
                del by_room[heapq.heappop(rooms) * -1]
            used = min(packs, left)
            put((used, room - length, [*pieces, (length, rank)]))
            if packs > used:
                put((packs - used, room, [(size, first + used) for size, first in pieces]))
            rank, left = rank + used, left - used
    return [p for room in sorted(by_room) for p in by_room[room]]


def taken_apart(packed: list[Pattern], capacity: int = CAPACITY, least_gap: int = LEAST_GAP) -> tuple[list[Pattern], list[Pattern]]:
    """(patterns that stay, patterns whose pieces fit into the gaps of those); the shortest packs go first."""
    spare = sum(packs * room for packs, room, _ in packed if room >= least_gap)
    stay, go = [], []
    for packs, room, pieces in sorted(packed, key=lambda p: -p[1]):
        cost = capacity if room >= least_gap else capacity - room
        n = min(packs, spare // cost)
        spare -= n * cost
        if n:
            go.append((n, room, pieces))
        if packs > n:
            stay.append((packs - n, room, [(size, first + n) for size, first in pieces]))
    return stay, go


class Plan:
    """Where each (length, rank) lies; its size depends on the capacity alone."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, least_gap: int = LEAST_GAP):
        stay, go = taken_apart(patterns(histogram, capacity), capacity, least_gap)
        runs, gaps, sequence, filled = [], [], 0, 0
        for packs, room, pieces in stay:
            offset = 0
            for length, first in pieces:
                runs.append((length << RANK_BITS | first, first, sequence, offset, -1))
                offset += length
            if room >= least_gap:
                gaps.append((filled, room, sequence, offset))
                filled += room * packs
            sequence += packs
        poured = 0
        for packs, _, pieces in go:
            for length, first in pieces:
                runs.append((length << RANK_BITS | first, first, -1, 0, poured))
                poured += length * packs
        self.runs = np.array(sorted(runs), np.int64).reshape(-1, 5).T
        self.gaps = np.array(gaps, np.int64).reshape(-1, 4).T
        self.sequences = sequence

    def places(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, ...]:
        """(index of the piece, tokens of the piece before, length, sequence, offset) of each part; parts of a piece are in order."""
        at = np.searchsorted(self.runs[0], lengths << RANK_BITS | ranks, "right") - 1
        _, first, sequence, offset, poured = self.runs[:, at]
        nth = ranks - first
        whole = np.flatnonzero(poured < 0)
        out = [(whole, np.zeros(len(whole), np.int64), lengths[whole], sequence[whole] + nth[whole], offset[whole])]
        index = np.flatnonzero(poured >= 0)
        place, left, done = poured[index] + nth[index] * lengths[index], lengths[index], np.zeros(len(index), np.int64)
        while len(index):
            begin, room, seq, base = self.gaps[:, np.searchsorted(self.gaps[0], place, "right") - 1]
            pack, inside = np.divmod(place - begin, room)
            n = np.minimum(left, room - inside)
            out.append((index, done, n, seq + pack, base + inside))
            more = left > n
            index, place, left, done = index[more], (place + n)[more], (left - n)[more], (done + n)[more]
        parts = [np.concatenate(c) for c in zip(*out)]
        order = np.lexsort((parts[1], parts[0]))
        return tuple(p[order] for p in parts)


def _writer(folder: str, path: str, end_id: int, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, name, out, counts = word_ids(path), f"{folder}/{uuid.uuid4().hex}.arrow", None, np.zeros(capacity + 1, np.int64)
        for batch in slices(batches):
            texts, at = batch.column(1).cast(pa.string()), 0
            for n, ids, sizes in bpe.encode(texts):
                ids = np.insert(ids, np.cumsum(sizes), bpe.dtype(end_id))
                sizes = sizes + 1
                rest, full = sizes % capacity, sizes // capacity
                ends = np.cumsum(sizes * bpe.dtype().itemsize).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.r_[np.int32(0), ends].astype(np.int32)), pa.py_buffer(ids)])
                rows = pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(sizes), data], names=["id", "n_tokens", "ids"])
                if out is None:
                    store, file = file_system(name)
                    store.create_dir(file.rpartition("/")[0], recursive=True)
                    sink = store.open_output_stream(file, compression=None)
                    out = pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                out.write_batch(rows)
                counts += np.bincount(rest, minlength=capacity + 1)
                counts[capacity] += full.sum()
                counts[0] = 0
                at += n
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([counts.tolist()], pa.list_(pa.int64()))], names=MANIFEST.names)
    return run


def _ranks(lengths: np.ndarray, next_rank: np.ndarray) -> np.ndarray:
    """The ranks of pieces in order, counted on from next_rank (one number per length), which is moved."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    first = np.r_[0, np.flatnonzero(np.diff(ordered)) + 1]
    inside = np.arange(len(ordered)) - np.repeat(first, np.diff(np.r_[first, len(ordered)]))
    ranks = np.empty(len(lengths), np.int64)
    ranks[order] = next_rank[ordered] + inside
    next_rank += np.bincount(lengths, minlength=len(next_rank))
    return ranks


def _reader(plan: Plan, width: int, capacity: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def place(rows: pa.RecordBatch, next_rank: np.ndarray) -> pa.RecordBatch:
        sizes = rows.column(1).to_numpy()
        n = -(-sizes // capacity)
        doc = np.repeat(np.arange(len(sizes)), n)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        lengths = np.minimum(capacity, sizes[doc] - nth * capacity)
        piece, before, length, sequence, offset = plan.places(lengths, _ranks(lengths, next_rank))
        doc, start = doc[piece], nth[piece] * capacity + before
        ids = rows.column(2)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset:ids.offset + len(ids) + 1] // width
        tokens = np.frombuffer(ids.buffers()[2], f"<u{width}")
        # parts of a document are in order and leave nothing out, so all ids in a row are the data of the parts
        data = tokens[ends[0]:ends[-1]].astype("<u4")
        edges = np.r_[0, np.cumsum(length * 4)].astype(np.int32)
        binary = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(edges), pa.py_buffer(data)])
        columns = [rows.column(0).take(pa.array(doc)), *(pa.array(c) for c in (start, length, sizes[doc], sequence, offset)), binary]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                store, path = file_system(b.column(0)[k].as_py())
                next_rank = np.array(b.column(1)[k].as_py(), np.int64)
                with store.open_input_stream(path, compression=None) as f:
                    for rows in pa.ipc.open_stream(f):
                        yield place(rows, next_rank)
    return run


def pack(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         least_gap: int = LEAST_GAP) -> DataFrame:
    """One row a piece: the document's id, start (its ids before the piece), length, doc_tokens, sequence_id, offset, ids (unsigned 32-bit).

    sequence_id counts from 0 without holes; the pieces of a sequence lie one behind the other from offset 0.
    """
    rows = id_and_text(docs, id_col, text_col)
    spark = docs.sparkSession
    manifest = lineage.cut(rows.mapInArrow(_writer(folder, path, end_id, capacity), MANIFEST))
    sizes = manifest.select(F.posexplode("counts").alias("length", "n")).where("n > 0").groupBy("length").agg(F.sum("n").alias("n"))
    plan = Plan({r["length"]: r["n"] for r in sizes.collect()}, capacity, least_gap)
    # of each length, the pieces in the files before: one window a length over one row a file
    counted = manifest.select("file", F.posexplode("counts").alias("length", "n"))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    ranked = counted.select("file", "length", F.coalesce(earlier, F.lit(0).cast("long")).alias("before"))
    files = ranked.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("length", "before"))), lambda x: x["before"]).alias("next_rank"))
    longs = [StructField(c, LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")]
    schema = StructType([rows.schema.fields[0], *longs, StructField("ids", BinaryType())])
    dealt = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    width = word_ids(path).dtype().itemsize
    return dealt.mapInArrow(_reader(plan, width, capacity, schema.names), schema)


def sequences(pieces: DataFrame, pad_id: int, capacity: int = CAPACITY) -> DataFrame:
    """One row a sequence: sequence_id, length (without padding), ids (padded to the capacity, unless the length is a power of two), ends
    (where each piece ends, for masks between documents)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    rows = pieces.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    pads = F.when(F.bit_count("length") == 1, 0).otherwise(capacity - F.col("length")).cast("int")
    fill = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), pads))
    ends = F.transform("parts", lambda p: p["offset"] + p["length"])
    return rows.select("sequence_id", "length", F.concat(joined, fill).alias("ids"), ends.alias("ends"))
