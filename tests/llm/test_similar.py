import random

import corpus_pipeline
from sonaria.llm import similar


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def planted(n=40, words=400, seed=11):
    """Texts and their near copies at 0.8 to 0.95, and others below the threshold."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, near, far = [], [], []
    for k in range(n):
        base = [r.choice(vocabulary) for _ in range(words)]
        rows.append((10 * k, " ".join(base)))
        for i, target in enumerate((0.8, 0.9, 0.95, 0.6)):
            copy = list(base)
            places = list(range(2, words, 7))
            r.shuffle(places)
            while True:  # one word after the other, as long as the copy is like enough
                tried = list(copy)
                tried[places.pop()] = "x%d_%d_%d" % (k, i, len(places))
                if likeness(" ".join(base), " ".join(tried)) < target:
                    break
                copy = tried
            text = " ".join(copy)
            rows.append((10 * k + 1 + i, text))
            (near if target >= 0.8 else far).append((10 * k, 10 * k + 1 + i))
    return rows, near, far


def brute_kept(texts):
    """texts in order of preference -> positions kept, by components of all pairs at 0.8 or more."""
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if likeness(texts[i], texts[j]) >= 0.8 - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in range(len(texts)) if find(i) == i}


def test_near_copies_are_dropped_and_others_stay(spark):
    rows, near, far = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()}
    assert not kept & {b for _, b in near}
    assert kept == {rows[i][0] for i in brute_kept([t for _, t in rows])}
    assert {b for _, b in far} <= kept


def test_chains_through_one_that_is_not_the_first(spark):
    rows, _, _ = planted(12, 200, 5)
    rows = [(-i, t) for i, t in rows]  # the base of each group is its last
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ordered = sorted(rows)
    kept = sorted(r.doc_id for r in similar.keep_one(docs).collect())
    assert kept == sorted(ordered[i][0] for i in brute_kept([t for _, t in ordered]))


def test_rows_are_decided_one_by_one(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(50)) for p in "abc")
    rows = [(1, a), (1, a), (2, b), (2, a), (None, b), (None, c), (None, c), (3, ""), (4, None), (5, " ")]
    kept = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, a), (2, b), (None, c), (3, "")], key=str)


def test_empty(nothing):
    assert similar.keep_one(nothing).count() == 0


def test_fingerprints_give_the_pairs_within_two_bits(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [f ^ 1 << rng.randrange(64) ^ (1 << rng.randrange(64)) * (i % 2) for i, f in enumerate(fps * 3)] + fps[:10]
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    found = [(r.u, r.v) for r in similar.fingerprint_pairs(spark.createDataFrame(rows, "node long, fp long")).collect()]
    assert all(u > v and (fps[u] ^ fps[v]).bit_count() <= 2 for u, v in found)
    root = list(range(len(fps)))
    brute = root[:]
    for names, pairs in ((root, found), (brute, [(u, v) for u in range(len(fps)) for v in range(u) if (fps[u] ^ fps[v]).bit_count() <= 2])):
        for _ in names:
            for u, v in pairs:
                names[u] = names[v] = min(names[u], names[v])
    assert root == brute
