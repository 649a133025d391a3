"""Byte-level BPE encoding and decoding, exact against the tokenizers library.

Ordinary texts are encoded in place: no shuffle. A text is cut before each run of ASCII white space, where a pre-token always ends,
and pieces that come again are not encoded again (a worker caches up to CACHE_PIECES; the half that was met longer ago is dropped, which
bounds memory only).

Long texts take tree concatenation: a text is cut into pieces that different tasks encode in parallel; neighbours are then joined
pairwise, round by round. At a join, a window around it is encoded anew and grows until both sides agree with it.

* Texts of more than long_chars characters are cut at any place. The first token of each pre-token is marked; the window begins at
  a mark of the left side, far enough from its end that what follows can't move the mark. The sides agree where a pre-token of the
  window begins at a mark of the right side: pre-tokens depend on nothing before them, so from there on the right side stands.
  Both kinds of texts are found in one pass and kept apart, since a pattern over each text costs more than to read it.
* A long pre-token (a run of more than piece_bytes bytes in its letters) has no marks. It is cut by itself: the last k tokens of
  the left and the first k tokens of the right side are encoded anew as one text; k doubles until the new tokens start with the
  left side's token at that place and end with the right side's. A BPE encoding is right exactly if all neighbouring tokens are
  compatible, so from agreeing tokens outwards the two sides stand, and the result equals the encoding of the whole.

Null texts are empty (no tokens, decoded to empty), repeated rows give repeated results, a null id stays null, an empty table
gives no rows. Special tokens written in a text are matched, as the library does by default. Other columns are not read.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tripmarts import lineage
from tripmarts.llm.common import give_back, id_and_text, kept, map_columns, slices

PIECE_BYTES = 8192
LONG_CHARS, PIECE_CHARS = 65_536, 16_384
#: Set in an id that begins a pre-token or is a special token, while texts are joined.
MARK = 1 << 31
CACHE_PIECES = 50_000
#: Ids that are decoded by one lookup.
IDS_AT_ONCE = 1 << 18
WORDS = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: White space besides blank, tab and line ends: such texts go to the library whole.
OTHER_SPACE = re.compile("[" + "".join(map(chr, [11, 12, *range(28, 32), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])) + "]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def load(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@kept
def token_array(path: str) -> pa.Array:
    """token_bytes as one Arrow array, of which ids take what they stand for."""
    return pa.array(token_bytes(path), pa.large_binary())


def decoded(ids: bytes, tokens: pa.Array) -> str:
    """The text of little-endian unsigned 32-bit ids."""
    out = []
    for at in range(0, len(ids), 4 * IDS_AT_ONCE):
        taken = tokens.take(pa.array(np.frombuffer(ids, "<u4", min(IDS_AT_ONCE, (len(ids) - at) // 4), at)))
        _, ends, data = taken.buffers()
        out.append(memoryview(data or b"")[:np.frombuffer(ends, np.int64)[len(taken)]])
    return b"".join(out).decode("utf-8", "replace")


@kept
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id, read from the file: a worker that only decodes holds neither the library nor its merges."""
    with open(path, encoding="utf-8") as file:
        saved = json.load(file)
    letters_of = {i: t for t, i in saved["model"]["vocab"].items()} | {t["id"]: t["content"] for t in saved["added_tokens"]}
    back = {c: b for b, c in enumerate(byte_letters())}
    out = [b""] * (max(letters_of, default=-1) + 1)
    for i, t in letters_of.items():
        out[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
    return out


class ByteBpe(dict):
    """Piece of text -> its ids as little-endian 32-bit integers; also joins and decodes."""

    def __init__(self, path: str):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tok = load(path)
        self.model = self.tok.model
        letters = byte_letters()
        self.to_letters = {b: letters[b] for b in range(256)}
        added = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.added = added
        #: More bytes than a special token and what a pre-token looks ahead can have.
        self.margin = 4 * (max(map(len, added), default=0) + 4)
        self.marked_words: dict[str, bytes] = {}
        self.letters_of = {i: t for t, i in self.tok.get_vocab(with_added_tokens=True).items()}
        self.bytes_of = token_bytes(path)

    def letters(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.to_letters)

    def word(self, letters: str) -> list[int]:
        """Ids of one pre-token given in letters: merges only."""
        return [t.id for t in self.model.tokenize(letters)] if letters else []

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES // 2:
            self.older = dict(self)
            self.clear()
        known = self.older.get(piece)
        if known is not None:
            self[piece] = known
            return known
        word = piece[1:] if piece[0] == " " else piece
        if word.isalpha():
            ids = self.word(self.letters(piece))
        elif word[:-1].isalpha() and word[-1] in ".,":
            ids = self.word(self.letters(piece[:-1])) + self.word(word[-1])
        else:
            ids = self.tok.encode(piece, add_special_tokens=False).ids
        out = as_bytes(ids)
        if len(piece) <= 256:
            self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        if OTHER_SPACE.search(text):
            return as_bytes(self.tok.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.__getitem__, WORDS.findall(text)))

    def join(self, left: list[int], right: list[int], start: int = 4) -> list[int]:
        """Encoding of the concatenation of two encoded halves of one pre-token."""
        k = start
        while left and right:
            a, b = left[-k:], right[:k]
            new = self.word("".join(map(self.letters_of.__getitem__, a + b)))
            if (len(a) == len(left) or new[0] == a[0]) and (len(b) == len(right) or new[-1] == b[-1]):
                return left[: len(left) - len(a)] + new + right[len(b):]
            k *= 2
        return left + right


    def marked(self, text: str) -> array:
        """Ids of a text, with MARK in the first of each pre-token and in special tokens."""
        out, known = array("I"), self.marked_words
        for part in self.special.split(text) if self.special else [text]:
            if part in self.added:
                out.append(self.added[part] | MARK)
                continue
            for letters, _ in self.tok.pre_tokenizer.pre_tokenize_str(part):
                ids = known.get(letters)
                if ids is None:
                    if len(known) >= CACHE_PIECES:
                        known.clear()
                    first, *rest = self.word(letters)
                    ids = as_bytes([first | MARK, *rest])
                    if len(letters) <= 256:
                        known[letters] = ids
                out.frombytes(ids)
        return out

    def join_texts(self, left: array, right: array) -> array:
        """marked() of the concatenation of two texts, given marked() of each."""
        k = self.margin
        while left and right:
            begin = next((i for i in range(len(left) - k, 0, -1) if left[i] & MARK), 0)
            end = next((i for i in range(k, len(right)) if right[i] & MARK), len(right))
            before, after = ([self.bytes_of[i & ~MARK] for i in side] for side in (left[begin:], right[:end]))
            window = b"".join(before + after)
            new = self.marked(window.decode())
            if end == len(right):
                return left[:begin] + new
            marks, at = {}, sum(map(len, before))
            for i, token in enumerate(after):
                if right[i] & MARK:
                    marks[at] = i
                at += len(token)
            at = 0
            for j, i in enumerate(new):
                if i & MARK and at in marks and at <= len(window) - self.margin:
                    return left[:begin] + new[:j] + right[marks[at]:]
                at += len(self.bytes_of[i & ~MARK])
            k *= 2
        return left + right


def as_bytes(ids: list[int]) -> bytes:
    return memoryview(array("I", ids)).tobytes()


def as_ids(data: bytes) -> array:
    out = array("I")
    out.frombytes(data)
    return out


@kept
def byte_bpe(path: str) -> ByteBpe:
    """Kept by the worker from task to task, while it encodes."""
    return ByteBpe(path)


def _encoder(path: str) -> Callable[[], Callable[[list[str]], list[pa.Array]]]:
    def make():
        bpe = byte_bpe(path)

        def work(texts: list[str]) -> list[pa.Array]:
            ids = [bpe.encode(t) for t in texts]
            return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
        return work
    return make


PIECES = StructType([StructField("key", StringType()), StructField("seq", LongType()), StructField("piece", LongType()),
                     StructField("pieces", LongType()), StructField("letters", StringType()), StructField("ids", BinaryType())])


def _cut(path: str, piece_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (key, text) to the rows of PIECES: what is split short comes encoded, long pre-tokens as pieces in letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                short: list[int] = []

                def flush() -> None:
                    if short:
                        rows.append((key, len(rows), 0, 1, None, as_bytes(short)))  # noqa: B023
                        short.clear()  # noqa: B023

                seq = 0
                for part in bpe.special.split(text) if bpe.special else [text]:
                    if part in bpe.added:
                        short.append(bpe.added[part])
                        continue
                    for letters, _ in bpe.tok.pre_tokenizer.pre_tokenize_str(part):
                        if len(letters) <= piece_bytes:
                            short += bpe.word(letters)
                            continue
                        flush()
                        cuts = range(0, len(letters), piece_bytes)
                        seq = len(rows)
                        rows += [(key, seq, i, len(cuts), letters[c:c + piece_bytes], None) for i, c in enumerate(cuts)]
                flush()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=PIECES.names)

    return run


def _encode_pieces(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for b in batches:
            ids = [i if letters is None else as_bytes(bpe.word(letters)) for letters, i in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(ids, pa.binary())], names=[*PIECES.names[:4], "ids"])
    return run


def _cut_texts(path: str, piece_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (key, text) to the rows of PIECES, with the piece as it is in place of letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = [text[c:c + piece_chars] for c in range(0, len(text), piece_chars)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n), pa.array([0] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([n] * n, pa.int64()),
                                                  pa.array(parts, pa.string()), pa.nulls(n, pa.binary())], names=PIECES.names)

    return run


def _encode_texts(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for b in slices(batches):
            ids = [bpe.marked(text).tobytes() for text in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(ids, pa.binary())], names=[*PIECES.names[:4], "ids"])
    return run


def _join_pieces(path: str, whole_texts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with the ids of two neighbours (right: null if there is none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)

        def join(x: bytes, y: bytes) -> bytes:
            if whole_texts:
                return bpe.join_texts(as_ids(x), as_ids(y)).tobytes()
            return as_bytes(bpe.join(list(as_ids(x)), list(as_ids(y))))

        for b in slices(batches):
            ids = [x if y is None else join(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(ids, pa.binary())], names=[*PIECES.names[:4], "ids"])
    return run


DONE = StructType([*PIECES.fields[:4], PIECES["ids"]])


def _joined(pieces: DataFrame, path: str, whole_texts: bool) -> DataFrame:
    """(key, seq, ids) of encoded pieces: neighbours are joined until each (key, seq) is one."""
    pieces = lineage.cut(pieces)
    widest = pieces.agg(F.max("pieces")).first()[0] or 1
    while widest > 1:
        both = pieces.groupBy("key", "seq", F.floor(F.col("piece") / 2).alias("piece")).agg(
            F.max(F.ceil(F.col("pieces") / 2)).alias("pieces"), F.max(F.when(F.col("piece") % 2 == 0, F.col("ids"))).alias("ids"),
            F.max(F.when(F.col("piece") % 2 == 1, F.col("ids"))).alias("right"))
        pieces = both.mapInArrow(_join_pieces(path, whole_texts), DONE)
        widest = -(-widest // 2)
    return pieces.select("key", "seq", "ids")


def _word_tree(texts: DataFrame, path: str, piece_bytes: int) -> DataFrame:
    """(key, ids) of distinct texts (key, text_) with long pre-tokens."""
    pieces = texts.mapInArrow(_cut(path, piece_bytes), PIECES).repartition("key", "seq", "piece").mapInArrow(_encode_pieces(path), DONE)
    ordered = F.sort_array(F.collect_list(F.struct("seq", "ids")))
    return _joined(pieces, path, False).groupBy("key").agg(F.aggregate(ordered, F.expr("cast('' AS binary)"), lambda done, x: F.concat(done, x["ids"])).alias("ids"))


def _text_tree(texts: DataFrame, path: str, piece_chars: int) -> DataFrame:
    """(key, ids) of distinct long texts (key, text_)."""
    pieces = texts.mapInArrow(_cut_texts(path, piece_chars), PIECES).repartition("key", "piece").mapInArrow(_encode_texts(path), DONE)

    def unmark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids = [(np.frombuffer(x, "<u4") & np.uint32(MARK - 1)).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["key", "ids"])

    return _joined(pieces, path, True).select("key", "ids").mapInArrow(unmark, StructType([PIECES["key"], PIECES["ids"]]))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", piece_bytes: int = PIECE_BYTES, long_chars: int = LONG_CHARS,
           piece_chars: int = PIECE_CHARS) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    rows = id_and_text(docs, id_col, text_col)
    run = max(1, piece_bytes // 4)
    unsplit = F.col("text_").rlike(rf"(?<![^ \t\n\r])[^ \t\n\r]{{{run}}}|(?<![ \t\n\r])[ \t\n\r]{{{run}}}")
    large = F.length("text_") > long_chars  # tested first: it is far cheaper than the pattern
    fields = [StructField("n_tokens", LongType()), StructField("ids", BinaryType())]
    out = map_columns(rows.where(~large).where(~unsplit), "text_", _encoder(path), fields, drop_text=True)
    apart = lineage.cut(rows.where(large | unsplit).select("*", F.sha2("text_", 256).alias("key"), unsplit.alias("unsplit_")))
    for chosen, tree, size in ((F.col("unsplit_"), _word_tree, piece_bytes), (~F.col("unsplit_"), _text_tree, piece_chars)):
        long = apart.where(chosen)
        coded = tree(long.select("key", "text_").dropDuplicates(["key"]), path, size)
        out = out.unionByName(long.select(id_col, "key").join(coded, "key").select(id_col, (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids"))
    return out


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Append the decoded text; a null list of ids decodes to the empty text."""
    at = encoded.columns.index(ids_col)
    schema = StructType([*encoded.schema.fields, StructField(out_col, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_array(path)
        for b in slices(batches):
            texts = [decoded(x or b"", tokens) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=schema.names)
        del tokens
        give_back()

    return encoded.mapInArrow(run, schema)
