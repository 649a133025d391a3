"""Whole batches of texts to ids of a word-level BPE (lower case, white space dropped): each distinct word of a batch is encoded once.

A batch is split at ASCII white space and its words are dictionary-coded by Arrow. Distinct words of plain letters, with signs behind them,
are merged together in numpy: every round merges, in each word, all places of its pair of least rank. That is the order of the library, as a
pair with a merged part never ranks before the merge that made the part (checked when a vocabulary is loaded). All other words, such as those
with digits, quotes, marks or scripts outside PLAIN, go to the library one by one. The ids of all words are then gathered by their codes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tripmarts.llm.bpe import byte_letters, load

#: Letters with one lower-case letter each that no normal form changes, and signs that form one pre-token in a row.
PLAIN = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž"
SIGNS = r"!#$%&()*+,\-./:;=?@\[\]^_`{}~"
#: Words above this many bytes are merged by the library, whose time does not grow with the number of rounds.
WORD_BYTES = 48
#: Bytes of text that are encoded at once; longer texts are cut at white space.
BATCH_BYTES = 8 << 20
SPACE = b" \t\n\r\x0b\f"


class PairTable:
    """(left id, right id) -> rank and merged id, by open addressing over numpy arrays."""

    def __init__(self, pairs: np.ndarray, made: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(4 * len(pairs) + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.zeros(1 << self.bits, np.int32)
        self.made = made.astype(np.int32)
        left = np.arange(len(pairs))
        at = self._slot(pairs)
        while len(left):
            free = self.keys[at[left]] < 0
            _, first = np.unique(at[left][free], return_index=True)
            won = left[free][first]
            self.keys[at[won]], self.rank[at[won]] = pairs[won], won
            left = np.setdiff1d(left, won)
            taken = self.keys[at[left]] >= 0
            at[left[taken]] = (at[left[taken]] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, keys: np.ndarray, none: int) -> np.ndarray:
        """The rank of each pair, or none."""
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.rank[at], none).astype(np.int32)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.rank[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class WordIds:
    """A vocabulary with a word-end suffix and byte letters; encode() gives what the library gives without special tokens."""

    def __init__(self, path: str):
        self.tok = load(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.dtype = np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32
        self.none = len(merges)
        self.size = len(vocab)
        left, right, made = (np.array([vocab[x] for x in xs], np.int64) for xs in zip(*((a, b, a + b) for a, b in merges)))
        born = np.full(self.size, -1, np.int64)
        born[made] = np.arange(len(made))
        if (np.maximum(born[left], born[right]) >= np.arange(len(made))).any() or len(np.unique(made)) != len(made):
            raise ValueError(f"{path}: merges are not in the order in which their parts are made")
        self.table = PairTable(left * self.size + right, made)
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)

    def merged(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of at least one byte (binary array, each one pre-token) and how many ids each word has."""
        n = len(words)
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + n + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
        ends -= ends[0]
        ids = self.inner[data]
        ids[ends[1:] - 1] = self.last[data[ends[1:] - 1]]
        word = np.repeat(np.arange(n), np.diff(ends))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            joined = word[1:] == word[:-1]
            rank = np.full(len(ids), self.none, np.int32)
            at = np.flatnonzero(joined)
            rank[at] = self.table.ranks(ids[at].astype(np.int64) * self.size + ids[at + 1], self.none)
            first = np.flatnonzero(np.r_[True, ~joined])
            spans = np.diff(np.r_[first, len(ids)])
            least = np.minimum.reduceat(rank, first)
            open_ = np.repeat(least < self.none, spans)
            if not open_.all():
                done.append((word[~open_], ids[~open_]))
            hit = open_ & (rank == np.repeat(least, spans))
            # of equal pairs that overlap, every other one from the left
            prior = np.r_[False, hit[:-1]]
            if (hit & prior).any():
                place = np.arange(len(hit))
                start = np.maximum.accumulate(np.where(hit & ~prior, place, 0))
                hit &= (place - start) % 2 == 0
            ids = np.where(hit, self.table.made[np.minimum(rank, self.none - 1)], ids)
            keep = open_ & ~np.r_[False, hit[:-1]]
            ids, word = ids[keep], word[keep]
        word = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        ids = np.concatenate([i for _, i in done]) if done else np.zeros(0, np.int32)
        return ids[np.argsort(word, kind="stable")].astype(self.dtype), np.bincount(word, minlength=n)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words without white space, and how many each has; the ids of a word are in a row."""
        parts = pc.extract_regex(words, f"^(?P<word>[{PLAIN}]*)(?P<signs>[{SIGNS}]*)$")
        plain = pc.and_(parts.is_valid(), pc.less_equal(pc.binary_length(words), WORD_BYTES))
        head, tail = (pc.cast(pc.utf8_lower(pc.if_else(plain, pc.fill_null(pc.struct_field(parts, i), ""), "")), pa.binary()) for i in (0, 1))
        out: list[np.ndarray] = []
        counts = np.zeros(len(words), np.int64)
        owner: list[np.ndarray] = []
        for side in (head, tail):
            some = pc.greater(pc.binary_length(side), 0)
            where = np.flatnonzero(some.to_numpy(zero_copy_only=False))
            ids, n = self.merged(side.filter(some))
            out.append(ids)
            owner.append(np.repeat(where, n))
            counts[where] += n
        rest = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        for i, w in zip(rest.tolist(), words.take(pa.array(rest)).to_pylist(), strict=True):
            ids = self.tok.encode(w, add_special_tokens=False).ids
            out.append(np.array(ids, self.dtype))
            owner.append(np.full(len(ids), i))
            counts[i] = len(ids)
        return np.concatenate(out)[np.argsort(np.concatenate(owner), kind="stable")], counts

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(texts)
        ends = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        ids, n = self.words(coded.dictionary)
        code = coded.indices.to_numpy()
        size = n[code]
        cum = np.r_[0, np.cumsum(size)]
        first = (np.cumsum(n) - n)[code] - cum[:-1]
        return ids[np.repeat(first, size) + np.arange(cum[-1])], np.diff(cum[ends - ends[0]])

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For parts of a string array without nulls, in order: (number of texts, their ids in a row, ids per text)."""
        sizes = np.asarray(pc.binary_length(texts), np.int64)
        start = 0
        while start < len(sizes):
            if sizes[start] > BATCH_BYTES:
                parts = [self._encode(pa.array([p.decode()]))[0] for p in cut_at_space(texts[start].as_py().encode())]
                ids = np.concatenate(parts)
                yield 1, ids, np.array([len(ids)])
                start += 1
                continue
            n = max(1, int(np.searchsorted(np.cumsum(sizes[start:]), BATCH_BYTES, "right")))
            ids, counts = self._encode(texts.slice(start, n))
            yield n, ids, counts
            start += n


def cut_at_space(text: bytes) -> Iterator[bytes]:
    """Parts of about BATCH_BYTES that end before white space."""
    at = 0
    while len(text) - at > BATCH_BYTES:
        found = [x for x in (text.find(s, at + BATCH_BYTES) for s in (bytes([b]) for b in SPACE)) if x >= 0]
        if not found:
            break
        end = min(found)
        yield text[at:end]
        at = end
    yield text[at:]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """Kept by the worker from task to task."""
    return WordIds(path)
