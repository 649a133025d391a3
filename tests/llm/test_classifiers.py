"""Quality and toxicity: held-out accuracy on the small table, identities, awkward rows."""

import itertools
import zlib

import numpy as np
import pytest

from tripmarts.llm import labelled, quality, toxicity
from tripmarts.llm.common import read_table

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("fn", "label", "folds", "held", "threshold", "least"), [(quality.quality, "quality", 3, 1, 0.5, 0.95), (toxicity.toxicity, "toxic", 4, 2, 0.3, 0.9)])
def test_held_out_accuracy(spark, fn, label, folds, held, threshold, least):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    got = fn(docs, labels, folds, held, threshold).collect()
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    assert len(got) == docs.count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
    unseen = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in unseen]) >= least


@pytest.mark.parametrize("fn", [quality.quality, toxicity.toxicity])
def test_awkward_rows(spark, docs, empty, fn):
    label = "quality" if fn is quality.quality else "toxic"
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)] + [(1, 0, 0), (None, 1, 1), (3, None, None), (4, 7, 7)], "doc_id bigint, quality int, toxic int")
    got = fn(docs, labels, 3, 1, 0.5).collect()
    assert sorted(repr(r["doc_id"]) for r in got) == sorted(repr(r["doc_id"]) for r in docs.collect())
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert fn(empty, labels, 3, 1, 0.5).count() == 0
    none = fn(docs, labels.limit(0), 3, 1, 0.5).collect()
    assert {r["score"] for r in none} == {0.0} and label


def test_linear_time_pairs():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=quality.BUCKETS + len(quality.STRUCTURE)), rng.normal(size=(quality.BUCKETS + len(quality.STRUCTURE), 3)), np.zeros(len(quality.STRUCTURE)), np.ones(len(quality.STRUCTURE)))
    cols, vals = np.array([1, 5, 9, 2, 8]), np.array([0.5, -1.0, 0.2, 0.3, 0.1])
    z = 0.3 + sum(m.w[c] * x for c, x in zip(cols, vals)) + sum(m.v[a] @ m.v[b] * x * y for (a, x), (b, y) in itertools.combinations(zip(cols, vals), 2))
    assert np.isclose(m.score(cols, vals, np.array([0]))[0], 1 / (1 + np.exp(-z)))


def test_every_window_is_compressed():
    text = "".join(chr(97 + i % 26) for i in range(1001))
    parts = toxicity.windows(text)
    assert b"".join(p[: toxicity.STEP] for p in parts[:-1]) + parts[-1] == text.encode()
    assert toxicity.windows("") == [b""]


def test_copies_do_not_make_words_toxic(make_prose):
    shared = make_prose(1, 80) + " zebra"
    docs = [(shared, 1, 1.0)] * 50 + [(make_prose(10 + i, 40) + " villain", 1, 1.0) for i in range(20)] + [(make_prose(200 + i, 40), 0, 1.0) for i in range(60)]
    assert {w.strip() for w in toxicity.toxic_words(docs)} == {b"villain"}


def test_sample_is_bounded_and_weighted(spark, docs):
    labels = spark.createDataFrame([(i, int(i > 8)) for i in range(1, 11)], "doc_id bigint, toxic int")
    train = [i for i in range(1, 11) if zlib.crc32(str(i).encode()) % 4 != 2]
    got = labelled.sample(docs, labels, "toxic", 4, 2, per_class=2)
    assert all(sum(y == k for _, y, _ in got) <= 2 for k in (0, 1))
    for k in (0, 1):
        n = sum((i > 8) == bool(k) for i in train)
        assert not [1 for _, y, _ in got if y == k] or np.isclose(sum(w for _, y, w in got if y == k), n)


def test_toxicity_scores_by_brute_force(spark):
    """Every score of the table again, window by window, from the fitted dictionaries and curve."""
    import math

    docs, labels = read_table(spark, SF, "documents").where("length(text) < 4000 OR text IS NULL"), read_table(spark, SF, "labels")
    model = toxicity.fit(labelled.sample(docs, labels, "toxic", 4, 2))
    plain, both = toxicity.compressor(model.ordinary), toxicity.compressor(model.toxic + model.ordinary)
    texts = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels, 4, 2, 0.3).collect()}
    beta, mean, scale = (list(map(float, a)) for a in model.curve)
    for r in texts:
        data, saved, at = (r["text"] or "").lower().encode(), [], 0
        while True:
            window = data[at:at + 64]
            saved.append(len(plain(window)) - len(both(window)))
            at += 48
            if at >= len(data) - 16:
                break
        first, second = (sorted(saved, reverse=True) * 2)[:2] if len(saved) == 1 else sorted(saved, reverse=True)[:2]
        x = [first, second] + [math.log(1 + sum(s >= m for s in saved)) for m in (2, 3, 4, 5, 6)] + [math.log(1 + len(saved))]
        z = beta[0] + sum(b * (v - m) / s for b, v, m, s in zip(beta[1:], x, mean, scale, strict=True))
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), rel=1e-9)
    assert len(got) == len(texts) > 500
