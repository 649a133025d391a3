"""Leaks against a full edit distance."""

import random

import numpy as np

from tripmarts.llm import decontaminate as D


def distance(passage, text):
    """Least edits of a passage against any stretch of a text."""
    prev, j = np.zeros(len(text) + 1, int), np.arange(len(text) + 1)
    for i, c in enumerate(passage):
        now = np.empty(len(text) + 1, int)
        now[0] = i + 1
        now[1:] = np.minimum(prev[:-1] + (text != c), prev[1:] + 1)
        prev = np.minimum.accumulate(now - j) + j
    return prev.min()


def edited(rng, text, n):
    s = list(text)
    for _ in range(n):
        k = rng.randrange(len(s))
        kind = rng.randrange(3)
        s[k:k + 1] = [[rng.choice("qzé")], [], [s[k], rng.choice("xj ")]][kind]
    return "".join(s)


def test_every_pair_within_the_budget_and_no_other(make_prose, monkeypatch):
    monkeypatch.setattr(D, "TEXT_CHARS", 2000)
    rng = random.Random(2)
    items = [make_prose(100 + i, n) for i, n in enumerate((4, 9, 14, 20, 40, 3, 2, 1))]
    passages = D.Passages.of([(i, D.characters(t)) for i, t in enumerate(items)])
    texts = []
    for n in range(60):
        source = rng.choice(items)
        at = rng.randrange(0, max(1, len(source) - 100))
        texts.append(make_prose(n, 8) + " " + edited(rng, source[at:at + rng.randrange(30, 220)], rng.randrange(0, 14)) + " " + make_prose(n + 500, 8))
    texts += ["", "a", items[0], items[4].upper().replace(" ", "  \n")]
    got = {(d, i): (e, n) for d, i, e, n, _ in passages.search(texts)}
    for d, t in enumerate(texts):
        c = D.characters(t)
        for i in range(len(items)):
            mine = np.flatnonzero(passages.items == i)
            all_edits = [(distance(passages.chars[p, : passages.lengths[p]], c), passages.budgets[p]) for p in mine]
            within = [x for x, k in all_edits if x <= k]
            assert got.get((d, i)) == ((min(within), len(within)) if within else None)
    assert len(got) >= 15


def test_awkward_rows_and_several_blocks(spark, docs, empty, make_prose, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", 300)
    rows = docs.collect()
    bench = spark.createDataFrame([(1, make_prose(3, 60), "a"), (2, make_prose(9, 5000)[9000:9400], "b"), (2, None, "c"), (None, "", "d"), (4, "short", "e"), (None, make_prose(6, 30), "f"), (5, make_prose(900, 50), "g")],
                                  "item_id int, text string, doc_id string")
    found = sorted((repr(r["doc_id"]), repr(r["item_id"]), r["edits"]) for r in D.leaks(docs, bench).collect())
    assert found == sorted([("3", "1", 0), ("10", "1", 0), ("10", "1", 0), ("9", "2", 0), ("None", "None", 0)])
    kept = D.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    bad = {3, 9}
    assert kept.count() == sum(not (r["doc_id"] in bad or r["text"] in (make_prose(3, 60), make_prose(6, 30))) for r in rows)
    assert D.leaks(empty, bench).count() == 0 and D.leaks(docs, bench.limit(0)).count() == 0 and D.keep_clean(docs, bench.limit(0)).count() == len(rows)


def test_every_quote_of_a_passage_length_is_found(make_prose):
    item = make_prose(77, 60)
    c = "".join(map(chr, D.characters(item)))
    passages = D.Passages.of([(0, D.characters(item))])
    quotes = [c[o:o + n] for n in (64, 75) for o in range(len(c) - n + 1)]
    texts = ["#" * 40 + q.strip() + "#" * 40 for q in quotes]
    found = {d for d, *_ in passages.search(texts)}
    assert [q for d, q in enumerate(quotes) if len(q.strip()) >= 64 and d not in found] == []
