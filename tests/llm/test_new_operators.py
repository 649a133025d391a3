"""Fill-in-middle, packing and the filter audit against brute force, and on awkward rows."""

import hashlib
import random
import re
import struct
import zlib
from itertools import permutations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tripmarts import lineage
from tripmarts.llm import filter_audit, infill, packing
from tripmarts.llm.word_ids import WORD_BYTES, WordIds

WORDS = public_tokenizers.path("word_bpe_49k.json")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def library_ids(text):
    tok = Tokenizer.from_file(WORDS)
    return tok.encode(text or "", add_special_tokens=False).ids


def test_word_ids_equal_the_library(make_prose):
    rng = random.Random(5)
    signs = "aAzZéÉßŠžİıŁ.,;:!?#$%&*|<>'\"()-_/\\0159½²中文й́  \x1c\x85 \t\n\x0b😀"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    texts += ["aaaa" * k + "b" * k for k in range(1, 30)] + ["a" * WORD_BYTES, "a" * (WORD_BYTES + 1), "don't can'T 'S", "<|endoftext|> x<|startoftext|>y", "", " ", make_prose(4, 3000)]
    bpe, got = WordIds(WORDS), []
    for _, ids, counts in bpe.encode(pa.array(texts)):
        at = 0
        for n in counts.tolist():
            got.append(ids[at:at + n].tolist())
            at += n
    tok = Tokenizer.from_file(WORDS)
    assert got == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_word_ids_of_parts(make_prose, monkeypatch):
    import tripmarts.llm.word_ids as module

    text = make_prose(8, 2000) + "\n\n" + "x" * 5000 + " " + make_prose(9, 500)
    bpe = WordIds(WORDS)
    monkeypatch.setattr(module, "BATCH_BYTES", 700)
    parts = list(bpe.encode(pa.array(["a", text, "b c"])))
    assert [i for _, ids, _ in parts for i in ids.tolist()] == sum((library_ids(t) for t in ("a", text, "b c")), [])
    assert sum(n for n, _, _ in parts) == 3


def plain_infill(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", text, None, None
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", f"<S>{s}<P>{p}<M>{m}", p, m) if h4 % 100 < 80 else (n, "psm", f"<P>{p}<S>{s}<M>{m}", p, m)


def test_infill_against_brute_force(spark, docs, empty):
    rng = random.Random(2)
    alphabet = "ab é😀$1\\<>PSM \t\n\x0b\x0c\r\x00  {}()"
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 80)))) for i in range(400)] + [(1000 + i, t) for i, t in enumerate(["<P>", "a<M>b", " ", "\n", "w " * 60_000, " " * 100_000 + "x", "y" * 200_000])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (table, docs):
        found = infill.infill(df)
        assert found.columns == [*df.columns, "infill"]
        x, cut = F.col("infill"), infill.parts(F.col("infill.output"), F.col("infill.form"))
        read = found.select("doc_id", "text", "infill.*", infill.restored(x["output"], x["form"]).alias("back"), cut["prefix"].alias("p"), cut["middle"].alias("m")).collect()
        for r in read:
            assert (r["n"], r["form"], r["output"], r["p"], r["m"]) == plain_infill(r["doc_id"], r["text"]) and r["back"] == (r["text"] or "")
        assert len(read) == df.count()
    assert infill.infill(empty).count() == 0
    taken = infill.infill(docs.withColumnRenamed("fp", "INFILL"))
    assert taken.columns[-1] == "infill_" and taken.select("INFILL").first()[0] == "kept"


def check_pieces(spark, df, capacity, least_gap=packing.LEAST_GAP):
    pieces = packing.pack(df, lineage.shared_folder(spark, "packing-test"), WORDS, 2, capacity=capacity, least_gap=least_gap)
    rows = pieces.collect()
    by_sequence, by_document = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_document.setdefault(r["doc_id"], []).append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    want = {}
    for r in df.select("doc_id", "text").collect():
        want.setdefault(r["doc_id"], []).append(struct.pack(f"<{(n := len(ids := library_ids(r['text']) + [2]))}I", *ids))
    for doc_id, texts in want.items():
        got = sorted(by_document.pop(doc_id), key=lambda r: r["start"])
        assert sum(r["length"] for r in got) == sum(len(t) for t in texts) // 4
        if len(texts) == 1:
            assert b"".join(bytes(r["ids"]) for r in got) == texts[0] and {r["doc_tokens"] for r in got} == {len(texts[0]) // 4}
            assert [r["start"] for r in got] == [sum(x["length"] for x in got[:k]) for k in range(len(got))]
    assert not by_document
    return rows, by_sequence


def test_packing_of_documents(spark, docs, empty, make_prose):
    for capacity in (16, 64, 4096):
        check_pieces(spark, docs, capacity)
    table = spark.createDataFrame([(i, make_prose(i, 1 + i * 7 % 300)) for i in range(300)], "doc_id int, text string").repartition(5)
    rows, by_sequence = check_pieces(spark, table, 512)
    tokens = sum(r["length"] for r in rows)
    assert len(by_sequence) <= -(-tokens // 512) * 1.02 + 1
    assert packing.pack(empty, lineage.shared_folder(spark, "none"), WORDS, 2).count() == 0


def test_packing_fills_gaps(spark, make_prose):
    """Documents a little over half the capacity: without cuts, each would fill a sequence by itself."""
    table = spark.createDataFrame([(i, make_prose(i, 40)) for i in range(120)], "doc_id long, text string").repartition(3)
    rows, by_sequence = check_pieces(spark, table, 80, least_gap=4)
    tokens = sum(r["length"] for r in rows)
    assert len(by_sequence) <= -(-tokens // 80) * 1.03 + 1 < 120


def test_patterns_follow_the_histogram():
    rng = random.Random(1)
    for _ in range(50):
        capacity = rng.randrange(1, 60)
        histogram = {n: rng.randrange(1, 10 ** rng.randrange(1, 9)) for n in rng.sample(range(1, capacity + 1), rng.randrange(1, capacity + 1))}
        packed = packing.patterns(histogram, capacity)
        placed = {}
        for packs, room, pieces in packed:
            assert packs > 0 and room >= 0 and sum(n for n, _ in pieces) + room == capacity
            for n, first in pieces:
                placed.setdefault(n, []).append((first, first + packs))
        for n, spans in placed.items():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] == histogram[n] and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert len(packed) <= 3 * capacity
        stay, go = packing.taken_apart(packed, capacity, 1)
        tokens = sum(n * c for n, c in histogram.items())
        assert sum(p for p, _, _ in stay) == -(-tokens // capacity) and sum(p for p, _, _ in [*stay, *go]) == sum(p for p, _, _ in packed)


def test_sequences_join_pieces(spark, docs):
    pieces = packing.pack(docs.select("doc_id", "text"), lineage.shared_folder(spark, "packing-test"), WORDS, 2, capacity=256)
    for r in packing.sequences(pieces, 1, 256).collect():
        ids = struct.unpack(f"<{len(r['ids']) // 4}I", r["ids"])
        assert len(ids) == (r["length"] if r["length"] & (r["length"] - 1) == 0 else 256) and r["ends"][-1] == r["length"]
        assert set(ids[r["length"]:]) <= {1}


def plain_audit(rows, labels):
    """(part, order, step) -> counts, one document and order at a time."""
    facts = []
    for doc_id, lang, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copies = [i for i, _, t in rows if i is not None and doc_id is not None and i < doc_id and (t or "") == text]
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)), "E": bool(copies)}
        marks = [m for i, *m in labels if i is not None and i == doc_id]
        facts.append((lang or "", fails, any(q == 1 for q, _ in marks), any(t == 1 for _, t in marks)))
    out, shapley = {}, {}
    for order in permutations("ABCDE"):
        for part in {f[0] for f in facts}:
            left = [f for f in facts if f[0] == part]
            for step, x in enumerate(order, 1):
                gone = [f for f in left if f[1][x]]
                left = [f for f in left if not f[1][x]]
                failing = sum(f[0] == part and f[1][x] for f in facts)
                alone = sum(f[0] == part and f[1][x] and sum(f[1].values()) == 1 for f in facts)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), alone, sum(f[2] for f in gone), sum(f[3] for f in gone)]
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_against_brute_force(spark, make_prose, docs, empty):
    rng = random.Random(4)
    texts = [make_prose(1, 150), make_prose(2, 150).upper(), make_prose(3, 99), "a b " * 60, "ABC $ %", "", None, " \x0b\n ", " ".join(f"w{i}" for i in range(120)), "#" + " ".join(f"w{i}" for i in range(120)), "été x " * 10]
    rows = [(rng.choice([None, *range(80)]), rng.choice(["en", "fr", "", None]), rng.choice(texts)) for _ in range(150)]
    rows += [(90 + i, "hot", texts[8]) for i in range(200)] + [(5, "en", texts[0])] * 3
    labels = [(i, rng.choice([0, 1, None, 2]), rng.choice([0, 1, None])) for i in [*range(0, 120, 2), 4, 4, None]]
    table = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("key", F.lit("kept")).withColumn("prefix", F.lit(1)).withColumn("part", F.lit("p"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("key", F.lit("x"))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in filter_audit.audit(table, marks).collect()}
    assert got == plain_audit(rows, labels)
    few = docs.select("doc_id", "lang", "text").collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in filter_audit.audit(docs, marks.limit(0)).collect()}
    assert got == plain_audit([(r["doc_id"], r["lang"], r["text"]) for r in few], [])
    assert filter_audit.audit(empty, marks).count() == 0


def test_packing_query(spark):
    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    whole = {i: struct.pack(f"<{len(ids := library_ids(t) + [2])}I", *ids) for i, t in texts.items()}
    rows = __spark_entry__.queries()["op12_packing"](spark, sf).collect()
    assert sum(r["length"] for r in rows) == sum(len(x) // 4 for x in whole.values())
    for r in rows:
        part = whole[r["doc_id"]][4 * r["start"]:4 * (r["start"] + r["length"])]
        assert len(part) == 4 * r["length"] and r["ids_crc32"] == zlib.crc32(part) and r["doc_tokens"] == len(whole[r["doc_id"]]) // 4
