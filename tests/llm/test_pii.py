"""Personal data against plain regular expressions; boosted trees and redaction."""

import re

from pyspark.sql import functions as F

from tripmarts.llm import pii


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


TEXTS = ["", None, "plain words", "a@b.c_d@e.f g@h, i@j.k.", "é 😀 x.y+z@mail-1.example.com und 1.2.3.4.5 256.1.1.1 001.002.003.255 0.0.0.0",
         "4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111 411111111111111 79927398713", "+1 (361) 555-8283 +12 +1234567890123456 +1.2.3.4.5.6.7.8.9 ++49 30 1234567",
         "@@..@ a@b a@b. -@-.- %@x.y", "9" * 3000, "a" * 3000 + "@" + "b." * 2000 + "c", "1 2 3 4 5 6 7 8 9 0 " * 300, "10.0.0.1" * 50, "x@y.z\n+49-30-1234567\t4111111111111111"]


def test_base_spans_are_exact(spark, docs, empty):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, TEXTS[5]), (None, TEXTS[6])]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = pii.find(df).collect()
    assert sorted((repr(r["doc_id"]), [tuple(s) for s in r["base"]]) for r in got) == sorted((repr(i), base(t or "")) for i, t in rows)
    assert all(set(map(tuple, r["base"])) <= set(map(tuple, r["spans"])) for r in got)
    assert pii.find(docs).count() == docs.count() and pii.find(empty).count() == 0
    assert pii.find(df.limit(2)).count() == 2


def test_trees_learn_and_thresholds_hold():
    cell = lambda mark, p, n: {"kind": 2, "digits": 4, "marks": mark, "lead": 1, "before": 1, "after": 1, "cue": 0, "positive": p, "negative": n}
    cells = [cell(0, 990, 10), cell(1, 10, 90), cell(2, 500, 500)]
    trees, start = pii.fit_trees(cells)
    scores = [pii._score_of(c, trees, start) for c in cells]
    assert scores[0] > scores[2] > scores[1]
    assert scores[2] < pii.thresholds(cells, cells, trees, start)[2] <= scores[0]
    assert pii.thresholds(cells, [cell(0, 9, 0)], trees, start)[2] == float("inf")
    assert pii.fit_trees([])[0] == [] and pii.thresholds([], [], [], 0.0) == [0.0] * 4


def test_column_score_is_the_same(spark):
    cells = [{"kind": k, "digits": d, "marks": m, "lead": 1, "before": b, "after": 1, "cue": c, "positive": 1 + k * d, "negative": 1 + m * b + c} for k in range(4) for d in range(3) for m in range(3) for b in range(3) for c in (0, 1)]
    trees, start = pii.fit_trees(cells)
    df = spark.createDataFrame(cells)
    got = df.select(F.struct(*pii.FEATURES).alias("c")).select(pii.tree_score(F.col("c"), trees, start).alias("s")).collect()
    assert all(abs(r["s"] - pii._score_of(c, trees, start)) < 1e-9 for r, c in zip(got, cells))


def test_loose_spans_and_redaction(spark, docs, empty):
    rows = [(i, f"call me at +1 (361) 555-{1000 + i} or 4111111111111111 or a{i}@b.org.") for i in range(40)] + [(100, "phone (361) 555-8283 or jo (at) mail (dot) org now"), (101, None), (102, "none"), (103, "host 1.2.3.4@x.yz 10.0.0.1")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    found = {r["doc_id"]: r for r in pii.find(df).collect()}
    assert [s["kind"] for s in found[100]["spans"]] == [0, 3] and not found[100]["base"]
    out = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert out[3] == "call me at <phone> or <card> or <email>."
    assert out[100] == "phone <phone> or <email> now" and out[101] is None and out[102] == "none" and out[103] == "host <email> <ip>"
    kept = pii.redact(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() and pii.redact(empty).count() == 0


def test_main_path_is_native(docs):
    plan = pii.redact(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
