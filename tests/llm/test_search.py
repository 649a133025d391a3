"""Top-k against scoring every document."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tripmarts.llm import search


def plain(rows, queries, k):
    """rows, queries: (id, text)."""
    bags = [Counter(search.terms_of(t or "")) for _, t in rows]
    n, mean = len(rows), sum(sum(b.values()) for b in bags) / max(1, len(rows))
    df = Counter(t for b in bags for t in b)
    out = []
    for q, text in queries:
        scored = []
        for (i, _), bag in zip(rows, bags):
            units = 0
            for t in set(search.terms_of(text or "")) & set(bag):
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                units += math.floor(idf * (bag[t] * (search.K1 + 1) / (bag[t] + search.K1 * (1 - search.B + search.B * sum(bag.values()) / mean))) * search.UNIT + 0.5)
            if units:
                scored.append((-units, i is None, i or 0))
        out += [(q, rank, None if none else i, -u / search.UNIT) for rank, (u, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k", [1, 3, 10])
def test_equals_scoring_all(spark, docs, empty, make_prose, monkeypatch, k):
    monkeypatch.setattr(search, "SHARD_DOCS", 5)
    monkeypatch.setattr(search, "BLOCK", 2)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    queries = [(i, t) for i, t in rows if i in (1, 3, 4, 9)] + [(50, make_prose(3, 5)), (51, "nothing-there"), (52, None)]
    asked = spark.createDataFrame(queries + [(None, "river"), (1, "zzz")], "doc_id bigint, text string")
    got = search.top_k(docs, asked, k).collect()
    assert sorted([(r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in got], key=repr) == plain(rows, queries, k)
    assert search.top_k(empty, asked, k).count() == 0 and search.top_k(docs, asked.limit(0), k).count() == 0


def test_pruning_loses_nothing():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    built = search.Builder()
    texts = []
    for i in range(700):
        t = " ".join(words[min(299, int(rng.expovariate(0.03)))] for _ in range(rng.randrange(1, 80)))
        texts.append(texts[-1] if i % 9 == 0 and texts else t)
        built.add(i // 2, texts[-1])
    df = Counter(t for x in texts for t in set(x.split()))
    names = sorted(df)
    shard = search.Shard(built.arrays(), pa.array(names), np.array([df[t] for t in names], float), 700, sum(len(t.split()) for t in texts) / 700)
    for text in texts[:80]:
        terms = np.array([names.index(t) for t in set(text.split())])
        total = np.zeros(700)
        for i in shard.number[terms]:
            a, b = shard.first[i], shard.first[i + 1]
            total[shard.doc[a:b]] += shard.impact[a:b]
        want = sorted(((-int(total[i]), i // 2) for i in range(700) if total[i]))[:7]
        assert [(-s, i) for i, s in shard.search(terms, 7)] == want
