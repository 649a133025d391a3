"""Token counts, BPE and token files against the tokenizers library."""

import os
import random
import struct
import subprocess
import sys

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer
from tokenizers.models import Unigram

import corpus_pipeline
from tripmarts import lineage
from tripmarts.llm import bpe, token_counts, token_files
from tripmarts.llm.word_ids import WordIds

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def by_id_and_text(rows, value):
    return sorted((repr(r[0]), value(r)) for r in rows)


def test_counts_equal_a_plain_unigram_model(docs, empty):
    scores = token_counts.zipf_scores(PIECES)
    least = min(scores.values())
    plain = Tokenizer(Unigram([("<unk>", least)] + list(scores.items()) + [(f"<0x{b:02X}>", least - 1000) for b in range(256)], 0, byte_fallback=True))
    got = token_counts.token_counts(docs, PIECES)
    assert got.columns == ["doc_id", "n_tokens", "n_pre_tokens", "log_score"]

    def count(text):
        return sum(len(plain.encode(w, add_special_tokens=False).ids) for w in token_counts.pre_tokens(text or ""))

    want = sorted((repr(r["doc_id"]), count(r["text"])) for r in docs.collect())
    assert by_id_and_text(got.collect(), lambda r: r["n_tokens"]) == want
    assert token_counts.token_counts(empty, PIECES).count() == 0


def test_trie_gives_the_same_counts_when_it_is_dropped():
    scores = {"a": -1.0, "ab": -1.2, "b": -2.0, "abc": -9.0, "c": -1.0}
    small, large = token_counts.PrefixTrie(scores, limit=3), token_counts.PrefixTrie(scores)
    words = ["abc", "ab", "abcab", "ü", "cab", "abc"]
    assert [small[w] for w in words] == [large[w] for w in words]
    assert large["abc"] == (2, -2.2) and large["ü"][0] == 2


def test_only_pieces_that_end_at_a_node_are_tried():
    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    scores = Counted({"a": -1.0, "ab": -1.2, "b": -2.0, "c" * 16: -3.0, "c": -1.0})
    trie = token_counts.PrefixTrie(scores)
    Counted.asked = 0
    words = ["ab" * n for n in range(1, 40)] + ["b" + "ab" * n for n in range(1, 40)]
    assert [trie[w][0] for w in words] == [n for n in range(1, 40)] + [n + 1 for n in range(1, 40)]
    assert Counted.asked < 100  # 1,985 when each of the last sixteen characters begins a lookup


def test_held_prefixes_are_bounded_in_characters():
    scores = {"a": -1.0, "b": -1.5}
    small, large = token_counts.PrefixTrie(scores, limit=400), token_counts.PrefixTrie(scores)
    words = ["b" * n + "ab" * 100 for n in range(1, 150)]
    assert [small[w] for w in words] == [large[w] for w in words]
    assert sum(map(len, small.node)) == small.held <= token_counts.NODE_CHARS * 400 + 350 * 350 < large.held


def test_decoding_in_parts_and_pieces_that_come_again(monkeypatch, spark):
    monkeypatch.setattr(bpe, "IDS_AT_ONCE", 3)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 4)
    tok, own = Tokenizer.from_file(BYTE), bpe.ByteBpe(BYTE)
    text = "one two üß three one 中文 two, two, one one 4 5 6 7 8 one"
    ids = own.encode(text)
    assert ids == struct.pack(f"<{len(ids) // 4}I", *tok.encode(text, add_special_tokens=False).ids) and len(own) + len(own.older) <= 4
    for cut in range(0, len(ids) + 1, 4):  # also between the bytes of one character
        assert bpe.decoded(ids[:cut], bpe.token_array(BYTE)) == tok.decode(list(bpe.as_ids(ids[:cut])), skip_special_tokens=False)
    done = []
    word = own.word
    monkeypatch.setattr(own, "word", lambda letters: done.append(letters) or word(letters))
    own.clear(), own.older.clear()
    own.encode(" ab cd ab ef ab gh ab ij ab kl ab")
    assert sum(own.to_letters[ord(" ")] + "ab" == d for d in done) == 1  # a piece in use survives what comes in between


def test_long_words_have_the_same_scores_without_nodes(make_prose):
    scores = token_counts.zipf_scores(PIECES)
    stored, unstored = token_counts.PrefixTrie(scores, long=10**6), token_counts.PrefixTrie(scores, long=0)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeinorst▁üß中") for _ in range(n)) for n in range(1, 200)] + ["x" * 5000, make_prose(4, 800).replace(" ", "")]
    assert [stored[w] for w in words] == [unstored[w] for w in words]
    assert not unstored and len(unstored.best) == 1


@pytest.mark.parametrize(("piece_bytes", "long_chars", "piece_chars"), [(64, 65_536, 16_384), (8192, 100, 990), (8192, 1000, 5000), (8192, 65_536, 16_384)])
def test_bpe_equals_the_library(docs, empty, piece_bytes, long_chars, piece_chars):
    tok = Tokenizer.from_file(BYTE)
    got = bpe.decode(bpe.encode(docs, BYTE, piece_bytes=piece_bytes, long_chars=long_chars, piece_chars=piece_chars), BYTE).collect()
    assert len(got) == docs.count()
    want = []
    for r in docs.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((repr(r["doc_id"]), (len(ids), struct.pack(f"<{len(ids)}I", *ids), r["text"] or "")))
    assert by_id_and_text(got, lambda r: (r["n_tokens"], bytes(r["ids"]), r["decoded"])) == sorted(want)
    assert bpe.encode(empty, BYTE).count() == 0


def test_awkward_texts(spark):
    tok = Tokenizer.from_file(BYTE)
    texts = ["<|endoftext|>a<|endoftext|> <|endoftext|", "a\xa0  b", "\x1c!\x1d  x", " \n lead", "it's we'LL 'tis", "tab\t\tend  ", "é́ é", "中文 混合 text", "a  b", "­​", "x" * 200 + "<|endoftext|>" + " " * 300 + "y" * 200]
    rng = random.Random(5)
    texts += ["".join(rng.choice("ab'sé 1.\n<|>中") for _ in range(400)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for piece_bytes in (32, 8192):
        got = {r["doc_id"]: bytes(r["ids"]) for r in bpe.encode(df, BYTE, piece_bytes=piece_bytes).collect()}
        for i, t in enumerate(texts):
            ids = tok.encode(t, add_special_tokens=False).ids
            assert got[i] == struct.pack(f"<{len(ids)}I", *ids), t
    word = Tokenizer.from_file(WORD)
    coder = WordIds(WORD)
    for t in texts + ["ΣΑΣ ὈΔΥΣΣΕΎΣ", "İstanbul ß", "Ünïcode.,", "can't", "...x"]:
        assert next(coder.encode(pa.array([t])))[1].tolist() == word.encode(t, add_special_tokens=False).ids, t


def test_joining_halves_at_every_place():
    coder = bpe.byte_bpe(BYTE)
    rng = random.Random(1)
    for alphabet in ("ab", "thein", "0123", " ", "éß"):
        text = coder.letters("".join(rng.choice(alphabet) for _ in range(120)))
        whole = coder.word(text)
        for at in range(0, len(text) + 1):
            assert coder.join(coder.word(text[:at]), coder.word(text[at:]), start=1) == whole


def test_joining_texts_at_every_place(make_prose):
    coder, tok = bpe.byte_bpe(BYTE), Tokenizer.from_file(BYTE)
    rng = random.Random(7)
    signs = ["a", "'s", "'ll", " ", "  ", "\n", "\t", "1", "é", "中", "\xa0", "<|endoftext|>", "!", "<|", "the", " it's"]
    texts = ["".join(rng.choice(signs) for _ in range(300)) for _ in range(4)] + [make_prose(5, 120) + "<|endoftext|>" + " " * 200 + make_prose(6, 120), "中" * 300 + "<|endoftext|>" * 9]
    for text in texts:
        whole = coder.marked(text)
        assert [i & ~bpe.MARK for i in whole] == tok.encode(text, add_special_tokens=False).ids
        for at in range(0, len(text) + 1, 3):
            assert coder.join_texts(coder.marked(text[:at]), coder.marked(text[at:])) == whole, (text, at)


def test_token_files_in_order_with_starts(spark, docs, empty):
    tok = Tokenizer.from_file(WORD)
    manifest = token_files.write_tokens(docs, lineage.shared_folder(spark, "tokens"), WORD, 2, frame_bytes=4096, file_bytes=20_000)
    rows = token_files.read_tokens(manifest).orderBy("start").collect()
    want = {}
    for r in docs.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want.setdefault(r["doc_id"], []).append(struct.pack(f"<{len(ids)}I", *ids))
    start = 0
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
        want[r["id"]].remove(bytes(r["ids"]))
    assert not any(want.values())
    ids = [r["id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert token_files.read_tokens(token_files.write_tokens(empty, lineage.shared_folder(spark, "tokens"), WORD, 2)).count() == 0


def test_reader_takes_only_the_frames_it_needs(tmp_path):
    path = f"file://{tmp_path}/a.tokens"
    out = token_files.TokenWriter(path, 2, frame_bytes=20)
    for i in range(50):
        out.add(i, struct.pack("<4H", i, 1, 2, 3))
    out.add(None, b"")
    out.close()
    file = token_files.TokenFile(path)
    assert len(file.table) > 10 and len(list(file)) == 51
    seen = []
    whole = file.frame
    file.frame = lambda i: seen.append(i) or whole(i)
    assert [(d, t.tolist()) for d, t in file.documents([17, 400])] == [(17, [17, 1, 2, 3])] and len(seen) == 1
    import zstandard
    data = (tmp_path / "a.tokens").read_bytes()
    assert len(zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()) == sum(size for _, size, _ in file.table)
    damaged = bytearray(data)
    damaged[6] ^= 1
    (tmp_path / "a.tokens").write_bytes(bytes(damaged))
    with pytest.raises(Exception):
        list(token_files.TokenFile(path).frame(0))


def test_decoding_needs_no_tokenizer():
    code = f"import sys; from tripmarts.llm import bpe; t = bpe.token_bytes({BYTE!r}); assert 'tokenizers' not in sys.modules; print(len(t))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(corpus_pipeline.__file__))
    assert int(out.stdout) == Tokenizer.from_file(BYTE).get_vocab_size()
