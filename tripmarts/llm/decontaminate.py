"""Benchmark decontamination: q-gram lemma filtering, verified by banded alignment.

Texts and items are lower-cased and white space is one blank. An item is searched in passages of PASSAGE characters, one each STRIDE
(an item of up to PASSAGE characters is one passage), so that parts of items are found too. A passage of length m leaks into a document
if the document has a stretch within k = m * EDIT_SHARE edits of it (insertions, deletions, substitutions). Every verbatim quote of at
least PASSAGE characters of an item is found: some passage starts at most STRIDE / 2 characters from it, and these are within k.

1. Characters are folded to a byte, Q of them are one integer; a bit table tells the few positions that have a q-gram of any passage.
2. Each of these gives its (passage, diagonal) places. Hits are counted in overlapping diagonal bands: BAND diagonals and the k after
   them, so that each stretch of k + 1 diagonals is whole in some band.
3. By the q-gram lemma a passage within k edits shares at least m - Q + 1 - k Q q-grams with its stretch, all in one band; bands with
   fewer hits are out. k is lowered where this bound were less than LEAST, so the filter loses nothing.
4. What is left is aligned within its band, all candidates of a block of texts at once. The result is exact: a (document, item) pair is
   given if and only if some passage is within its budget.

The items go to the tasks in blocks of at most BLOCK_CHARS characters, one pass over the documents a block, so what is broadcast is
bounded however large the benchmark is. Documents are never shuffled; a document's work is in one task.

Null texts and items are empty; passages of fewer than Q + LEAST - 1 characters are too short to tell and aren't searched; equal texts
under several item ids are found under each; repeated documents give repeated rows; null ids stay null. Empty tables give no rows, an
empty benchmark leaves all documents clean. Other columns are not read by `leaks`; `keep_clean` keeps them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tripmarts.llm.common import fresh_name, id_and_text, map_columns, slices

Q, LEAST, EDIT_SHARE = 8, 4, 0.1
PASSAGE, STRIDE, BAND = 64, 12, 16
BLOCK_CHARS = 1 << 20
#: Characters of documents that are worked on at once (a longer document is a block of its own).
TEXT_CHARS = 1 << 20
GAP = 64
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def characters(text: str) -> np.ndarray:
    """Code points of the normalised text."""
    return np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "surrogatepass"), "<u4")


def budget(m: int) -> int:
    """Edits allowed for a passage of m characters; -1 if it is too short."""
    return -1 if m < Q + LEAST - 1 else min(int(m * EDIT_SHARE), (m - Q + 1 - LEAST) // Q)


def grams(chars: np.ndarray) -> np.ndarray:
    """At each position the Q characters from there as an integer."""
    n = len(chars) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    folded = np.zeros(len(chars) + Q, np.uint8)
    folded[: len(chars)] = (chars ^ (chars >> np.uint32(8))) & np.uint32(0xFF)
    out = np.empty(-(-n // Q) * Q, np.uint64)
    rows = len(out) // Q
    folded = np.concatenate([folded, np.zeros(Q * Q, np.uint8)])
    for r in range(Q):
        out[r::Q] = folded[r:r + rows * Q].view("<u8")
    return out[:n]


@dataclass(frozen=True)
class Passages:
    """A block of the benchmark, ready to search."""
    items: np.ndarray
    chars: np.ndarray
    lengths: np.ndarray
    budgets: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    places: np.ndarray
    table: np.ndarray
    shift: int

    @staticmethod
    def of(items: list[tuple[int, np.ndarray]]) -> Passages:
        """From (item number, characters)."""
        owner, texts = [], []
        for item, c in items:
            starts = range(0, max(1, len(c) - PASSAGE + STRIDE), STRIDE) if len(c) > PASSAGE else [0]
            for s in starts:
                part = c[max(0, min(s, len(c) - PASSAGE)):][:PASSAGE]
                if budget(len(part)) >= 0:
                    owner.append(item)
                    texts.append(part)
        lengths = np.array([len(t) for t in texts], np.int64)
        chars = np.zeros((len(texts), PASSAGE), np.uint32)
        for i, t in enumerate(texts):
            chars[i, : len(t)] = t
        codes = [grams(t) for t in texts]
        code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        place = np.concatenate([np.int64(i) * PASSAGE + np.arange(len(g)) for i, g in enumerate(codes)]) if codes else np.zeros(0, np.int64)
        order = np.argsort(code, kind="stable")
        keys, first = np.unique(code[order], return_index=True)
        bits = max(16, int(np.ceil(np.log2(64 * max(1, len(keys))))))
        shift = 64 - bits
        table = np.zeros(1 << bits, bool)
        table[(keys * MULTIPLIER) >> np.uint64(shift)] = True
        return Passages(np.array(owner, np.int64), chars, lengths, np.array([budget(n) for n in lengths.tolist()], np.int64), keys, np.append(first, len(code)), place[order], table, shift)

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item number, edits, passages found, end of the best stretch in the normalised text) of all leaks."""
        out, part, size = [], [], 0
        for i, t in enumerate(texts):
            part.append((i, characters(t)))
            size += len(part[-1][1]) + GAP
            if size >= TEXT_CHARS:
                out += self._search(part)
                part, size = [], 0
        return out + self._search(part)

    def _hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passage and diagonal of each hit."""
        at = np.flatnonzero(self.table[(codes * MULTIPLIER) >> np.uint64(self.shift)])
        key = np.searchsorted(self.keys, codes[at])
        key[key == len(self.keys)] = 0
        same = self.keys[key] == codes[at]
        at, key = at[same], key[same]
        n = self.first[key + 1] - self.first[key]
        ends = np.cumsum(n)
        places = self.places[np.repeat(self.first[key] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return places // PASSAGE, np.repeat(at, n) - places % PASSAGE

    def _search(self, docs: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int, int, int]]:
        if not docs or not len(self.keys):
            return []
        gap = np.zeros(GAP, np.uint32)
        chars = np.concatenate([gap] + [x for _, c in docs for x in (c, gap)])
        begins = GAP + np.cumsum([0] + [len(c) + GAP for _, c in docs[:-1]])
        passage, diagonal = self._hits(grams(chars))
        if not len(passage):
            return []
        bands = 2 + len(chars) // BAND
        band = (diagonal + PASSAGE) // BAND
        early = (diagonal + PASSAGE) % BAND < self.budgets[passage]
        key = np.concatenate([passage * (bands + PASSAGE) + band, (passage * (bands + PASSAGE) + band - 1)[early]])
        key, count = np.unique(key, return_counts=True)
        passage, band = key // (bands + PASSAGE), key % (bands + PASSAGE)
        keep = count >= self.lengths[passage] - Q + 1 - self.budgets[passage] * Q
        passage, band = passage[keep], band[keep]
        best: dict[tuple[int, int], tuple[int, int, set]] = {}
        for at in range(0, len(passage), 4096):
            p, b = passage[at:at + 4096], band[at:at + 4096]
            edits, ends = self._align(chars, p, b * BAND - PASSAGE)
            for j in np.flatnonzero(edits <= self.budgets[p]).tolist():
                d = int(np.searchsorted(begins, ends[j] - 1, "right")) - 1
                pair = (d, int(self.items[p[j]]))
                old = best.get(pair, (1 << 30, 0, set()))
                mine = (int(edits[j]), int(ends[j] - begins[d]))
                best[pair] = (*min(mine, old[:2]), old[2] | {int(p[j])})
        return [(docs[d][0], item, e, len(found), end) for (d, item), (e, end, found) in sorted(best.items())]

    def _align(self, chars: np.ndarray, passage: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of each passage against stretches in diagonals low - k to low + BAND + 2k, and the end of the best stretch.

        Row by row over the passage, all candidates at once; a column is a diagonal. Stretches begin and end anywhere. The gaps between
        documents hold a character that no passage has, and a stretch across one would need GAP edits.
        """
        k = int(self.budgets.max())
        width = BAND + 3 * k + 1
        column = np.arange(width)
        first = low - k
        padded = np.concatenate([np.zeros(PASSAGE + 3 * BAND + 4 * k, np.uint32), chars, np.zeros(2 * PASSAGE + width, np.uint32)])
        offset = PASSAGE + 3 * BAND + 4 * k
        far = np.int64(1 << 20)
        cost = np.zeros((len(passage), width), np.int64)
        result, ends = np.full(len(passage), far), np.zeros(len(passage), np.int64)
        for i in range(PASSAGE):
            live = self.lengths[passage] > i
            if not live.any():
                break
            # column c of row i + 1 stands for i + 1 passage characters against text up to first + c + i + 1
            text = padded[np.clip(first[:, None] + column + i + offset, 0, len(padded) - 1)]
            step = cost + (text != self.chars[passage, i][:, None])
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
            step = np.minimum.accumulate(step - column, axis=1) + column
            cost = np.where(live[:, None], step, cost)
            done = self.lengths[passage] == i + 1
            if done.any():
                c = cost[done].argmin(axis=1)
                result[done], ends[done] = cost[done][np.arange(len(c)), c], first[done] + c + i + 1
        return result, ends


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list, Passages]]:
    """Blocks of at most BLOCK_CHARS characters (or one item): the item ids, by number, and the passages."""
    rows = benchmark.select(benchmark[item_col].alias("i"), F.coalesce(benchmark[text_col].cast("string"), F.lit("")).alias("t")).where("t != ''")
    ids, items, size = [], [], 0
    for r in rows.toLocalIterator():
        c = characters(r["t"])
        if items and size + len(c) > BLOCK_CHARS:
            yield ids, Passages.of(items)
            ids, items, size = [], [], 0
        items.append((len(ids), c))
        ids.append(r["i"])
        size += len(c)
    if items:
        yield ids, Passages.of(items)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per row of docs and row of benchmark that leaks into it: id, item, edits, passages, end (in the normalised text)."""
    rows = id_and_text(docs, id_col, text_col)
    schema = StructType([rows.schema.fields[0], StructField(fresh_name([id_col], item_col), benchmark.schema[item_col].dataType), StructField("edits", LongType()),
                         StructField("passages", LongType()), StructField("end", LongType())])
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    out = docs.sparkSession.createDataFrame([], schema)
    for ids, passages in blocks(benchmark, item_col, text_col):
        shared = docs.sparkSession.sparkContext.broadcast((ids, passages))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, block = shared.value
            for batch in slices(batches):
                found = block.search([t or "" for t in batch.column(1).to_pylist()])
                if found:
                    d, i, *rest = zip(*found, strict=True)
                    item = pa.array([names[x] for x in i], item_type)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), item] + [pa.array(x, pa.int64()) for x in rest], names=schema.names)

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of docs into which no item leaks, with all their columns."""
    flag = fresh_name(docs.columns, "leaks")
    for _, passages in blocks(benchmark, item_col, text_col):
        shared = docs.sparkSession.sparkContext.broadcast(passages)

        def make(shared=shared) -> Callable[[list[str]], list[pa.Array]]:
            def work(texts: list[str]) -> list[pa.Array]:
                hit = {x[0] for x in shared.value.search(texts)}
                return [pa.array([i in hit for i in range(len(texts))], pa.bool_())]
            return work

        docs = map_columns(docs, text_col, make, [StructField(flag, BooleanType())]).where(~F.col(flag)).drop(flag)
    return docs
