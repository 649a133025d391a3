"""The pipeline's near-duplicate stage against brute-force Jaccard groups."""

import random
import re

import numpy as np

import corpus_pipeline
from tripmarts.llm import near_copies, simhash
from tripmarts.llm.common import read_table

SF = "/root/testdata/sf0.01"


def plain_set(text, width=5):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    return frozenset([tuple(words[i:i + width]) for i in range(len(words) - width + 1)] or ([tuple(words)] if words else []))


def groups(texts):
    """Least index of the Jaccard component of each text."""
    sets = [plain_set(t) for t in texts]
    holders = {}
    for i, s in enumerate(sets):
        for x in s or [None]:
            holders.setdefault(x, set()).add(i)
    near = [sorted({j for x in s or [None] for j in holders[x] if 5 * len(s & sets[j]) >= 4 * len(s | sets[j])}) for s in sets]
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(near):
            low = min(root[j] for j in js)
            if low < root[i]:
                root[i], changed = low, True
    return root


def least_of(rows):
    """Ids that stay: the least of each group."""
    root = groups([r["text"] for r in rows])
    best = {}
    for r, c in zip(rows, root):
        best.setdefault(c, []).append(r["doc_id"])
    return sorted((repr(min((i for i in ids if i is not None), default=None)) for ids in best.values()))


def test_stage_on_given_documents(spark):
    docs = read_table(spark, SF, "documents")
    rows = docs.select("doc_id", "text").collect()
    want = least_of(rows)
    assert sorted(repr(r["doc_id"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == want
    assert len(want) < simhash.keep_one(docs).count()  # pairs at 5 to 10 differing bits, which two bits do not link


def test_chains_crowds_and_borders(spark, make_prose):
    rng = random.Random(3)
    texts = []
    for seed in range(12):  # copies around the border, chains of copies of copies
        words = make_prose(100 + seed, 90).split()
        for _ in range(8):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10 ** 6)}"
    base = make_prose(7, 60).split()
    texts += [" ".join(base[:k] + [f"odd{k}"] + base[k + 1:]) for k in range(60)]  # a crowd whose members are nearer to no other than to the base
    texts += [" ".join(base), "one two three", "One  two three", "", None, "   "]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(repr(r["doc_id"]) for r in near_copies.keep_one(df).collect()) == least_of(df.collect())


def test_crowds_of_copies_that_are_not_similar_enough(spark, make_prose, monkeypatch):
    rng = random.Random(5)
    base = make_prose(9, 150).split()
    texts = [" ".join(base)]
    for n in range(160):
        words = list(base)
        for at in rng.sample(range(6, 140, 5), 1 if n % 2 else 4):  # four edits are too many for a link, but near enough to be candidates
            words[at] = f"own{n}x{at}"
        texts.append(" ".join(words))
        if n % 8 == 0:
            words[rng.randrange(len(words))] = f"more{n}"  # linked by the edits in common alone
            texts.append(" ".join(words))
        if n % 10 == 0:
            texts.append(" ".join(base[:n // 10] + base[n // 10 + 40:]))  # nothing rare, linked by what is left out
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, root = [plain_set(t) for t in texts], list(range(len(texts)))
    for j, s in enumerate(sets):
        for i in range(j):
            if root[i] != root[j] and 5 * len(s & sets[i]) >= 4 * len(s | sets[i]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    want = sorted(map(repr, set(root)))
    assert 40 < len(want) < 100
    compared = []
    verified = near_copies.verified

    def counting(pairs, sets):
        compared[-1] += pairs.count()
        return verified(pairs, sets)

    monkeypatch.setattr(near_copies, "verified", counting)
    monkeypatch.setattr(near_copies, "COMMON", 16)
    for crowd in (8, 10 ** 6):
        monkeypatch.setattr(near_copies, "CROWD", crowd)
        compared.append(0)
        assert sorted(repr(r["doc_id"]) for r in near_copies.keep_one(df).collect()) == want
    assert compared[0] * 2 < compared[1]  # the second as before: pair by pair


def test_awkward_rows(docs, empty):
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns and sorted(repr(r["doc_id"]) for r in kept.collect()) == least_of(docs.collect())
    assert near_copies.keep_one(empty).count() == 0


def test_candidates_are_near_fingerprints(make_prose):
    rng = random.Random(8)
    along = near_copies.directions()
    first, second = [], []
    for seed in range(60):
        words = make_prose(seed, 300).split()
        first.append(near_copies.shingle_set(" ".join(words).encode()))
        for at in rng.sample(range(20, 280), 4):
            words[at] = "other"
        second.append(near_copies.shingle_set(" ".join(words).encode()))
    a, b = (np.array([near_copies.bit_counts(s) for s in sets]) for sets in (first, second))
    for s, counts in zip(first[:5], a[:5]):  # each bit is that of more than half of the hashes, remixed for each word
        hashes = s * near_copies.FACTORS[0]
        hashes = (hashes ^ (hashes >> np.uint64(32))) * near_copies.FACTORS[1]
        hashes = hashes ^ (hashes >> np.uint64(29))
        held = [sum(int(h) >> bit & 1 for h in word) for word in hashes for bit in range(64)]
        assert sorted(2 * h - len(s) for h in held) == sorted(counts.tolist())
    apart = ((a > 0) != (b > 0)).sum(axis=1)
    assert len(apart) and apart.max() <= near_copies.RADIUS and ((a[1:] > 0) != (b[:-1] > 0)).sum(axis=1).min() > near_copies.RADIUS
    shared = (near_copies.index_keys(a, along) == near_copies.index_keys(b, along)).any(axis=1)
    assert shared.mean() >= 0.95


def test_no_pair_at_the_least_similarity_is_missed(spark):
    rng = random.Random(11)

    def copy(words, edits):
        words = list(words)
        for at in rng.sample(range(5, len(words) - 5, 5), edits):
            words[at] = f"e{rng.randrange(10 ** 9)}"
        return " ".join(words)

    texts = []
    for n, edits, pairs in ((94, 2, 600), (93, 2, 30), (3000, 66, 6), (3000, 67, 6)):  # 80 of 100, 79 of 99, 2666 of 3326, 2661 of 3331 shingles
        for _ in range(pairs):
            words = [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]
            texts += [" ".join(words), copy(words, edits)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = least_of(df.collect())
    assert len(want) == len(texts) - 600 - 6
    assert sorted(repr(r["doc_id"]) for r in near_copies.keep_one(df).collect()) == want


def test_components_on_the_driver(spark):
    rng = random.Random(2)
    pairs = [tuple(sorted(rng.sample(range(-300, 300), 2))) for _ in range(250)]
    links = spark.createDataFrame(pairs, "a long, b long")
    assert sorted(near_copies.driver_components(links).collect()) == sorted(simhash.components(links).collect())
    assert near_copies.roots_of(links.limit(0)).count() == 0


def test_what_a_link_needs_is_never_ruled_out():
    rng = np.random.Generator(np.random.PCG64(4))
    common = np.sort(rng.integers(0, 1 << 63, 50, np.uint64))
    rank = rng.permutation(50)
    for n in (1, 4, 5, 9, 37, 300, 2500):
        for _ in range(20):
            whole = rng.integers(0, 1 << 63, n, np.uint64)
            whole[:n // 3] = rng.choice(common, n // 3) if n < 100 else whole[:n // 3]
            a = np.unique(whole[rng.random(n) > 0.08])
            b = np.unique(np.concatenate([whole[rng.random(n) > 0.08], rng.integers(0, 1 << 63, n // 30, np.uint64)]))
            shared = len(np.intersect1d(a, b))
            differ = len(a) + len(b) - 2 * shared
            assert np.bitwise_count(near_copies.parities(a).view(np.uint64) ^ near_copies.parities(b).view(np.uint64)).sum() <= differ
            counts = near_copies.bin_counts(a), near_copies.bin_counts(b)
            assert len(counts[0]) == (near_copies.BINS if len(a) > near_copies.LONG else 0)
            if all(map(len, counts)):
                assert np.abs(counts[0].astype(int) - counts[1]).sum() <= differ
            if len(a) and 5 * shared >= 4 * (len(a) + len(b) - shared):
                small, large = sorted((a, b), key=len)
                firsts = [near_copies.first_shingles(x, common, rank) for x in (small, large)]
                assert [len(x) for x in firsts] == [len(x) // 5 + 1 for x in (small, large)]
                assert len(np.intersect1d(firsts[0][:len(small) // 9 + 1], firsts[1]))
