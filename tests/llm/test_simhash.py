"""Fingerprints, links and components against brute force."""

import random
import re

import xxhash

from tripmarts.llm import simhash


def plain_fingerprint(text, width=3):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    parts = [b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(prints):
    """Least index that each value reaches over steps of 2 or fewer bits."""
    root = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2 and root[j] < root[i]:
                    root[i], changed = root[j], True
    return root


def test_fingerprints(docs, empty, monkeypatch):
    monkeypatch.setattr(simhash, "HASHES_AT_ONCE", 7)
    texts = [r["text"] for r in docs.collect()] + ["A b\x0bC d e", "one two", "É É É É"]
    got = simhash.fingerprints([(t or "").encode() for t in texts])
    assert [int(x) for x in got] == [plain_fingerprint(t) for t in texts]
    assert simhash.near_duplicates(empty).count() == 0


def test_components_with_chains_and_crowds(spark):
    rng = random.Random(4)
    prints = [0, 1, 3, 7 << 60]
    for _ in range(6):  # chains that drift far from where they start
        x = rng.getrandbits(64)
        for _ in range(12):
            prints.append(x)
            x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    x = rng.getrandbits(64)
    prints += [x] + [x ^ 1 << a ^ 1 << b for a in range(0, 64, 3) for b in range(a + 1, 64, 9)]  # a crowd around one value
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(i, 0, p) for i, p in enumerate(signed)], "id long, tie int, fp long")
    got = {r["fp"]: r["least"]["id"] for r in simhash.classes(df).collect()}
    assert [got[p] for p in signed] == closure(prints)


def test_near_duplicates_of_awkward_rows(docs):
    rows = docs.collect()
    prints = [plain_fingerprint(r["text"]) for r in rows]
    roots = closure(prints)
    least = {c: min((r["doc_id"] for r, x in zip(rows, roots) if x == c and r["doc_id"] is not None), default=None) for c in roots}
    want = sorted((repr(r["doc_id"]), f"{p:016x}", repr(least[c])) for r, p, c in zip(rows, prints, roots))
    got = simhash.near_duplicates(docs).collect()
    assert sorted((repr(r["doc_id"]), f"{r['fp'] & (1 << 64) - 1:016x}", repr(r["component_id"])) for r in got) == want


def test_one_row_of_each_component_stays(docs, empty):
    rows = docs.collect()
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    out = kept.collect()
    roots = closure([plain_fingerprint(r["text"]) for r in rows])
    assert len(out) == len(set(roots))
    groups = {}
    for r, c in zip(rows, roots):
        groups.setdefault(c, []).append(r)
    for c, members in groups.items():
        ids = [m["doc_id"] for m in members if m["doc_id"] is not None]
        mine = [o for o in out if o in members and o["doc_id"] == (min(ids) if ids else None)]
        assert len(mine) == 1
    assert simhash.keep_one(empty).count() == 0
