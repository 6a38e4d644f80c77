import random

import xxhash
from pyspark.sql import functions as F

from sonaria.llm import simhash


def brute_fingerprint(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (id, fp) -> {position: smallest id reachable}."""
    n = len(rows)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 2:
                root[find(i)] = find(j)
    best = {}
    for i in range(n):
        if rows[i][0] is not None:
            best[find(i)] = min(best.get(find(i), rows[i][0]), rows[i][0])
    return [best.get(find(i)) for i in range(n)]


def test_query_against_brute_force(awkward, rows_of):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(awkward).collect()), key=str)
    marks = [(i, brute_fingerprint(t, 3)) for i, t, _ in rows_of]
    want = sorted(((i, f"{fp:016x}", c) for (i, fp), c in zip(marks, brute_components(marks))), key=str)
    assert got == want


def test_links_of_random_fingerprints(spark):
    r = random.Random(3)
    fps = [r.getrandbits(64) for _ in range(60)]
    for fp in list(fps[:30]):  # chains of near ones, and ones three bits away
        for _ in range(5):
            fp ^= 1 << r.randrange(64)
            if r.random() < 0.5:
                fp ^= 1 << r.randrange(64)
            fps.append(fp)
        fps.append(fp ^ 0b111 << r.randrange(60))
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    want = brute_components(list(zip(signed, fps)))
    for segments, crowd in ((2, 64), (2, 2), (3, 64), (4, 0)):
        roots = {r.node: r.root for r in simhash.connected_components(simhash.links(df, segments, crowd)).collect()}
        assert [roots.get(s, s) for s in signed] == want


def test_radii_and_balls():
    assert simhash.radii(2, 2) == [1, 0] and simhash.radii(3, 2) == [0, 0, 0] and simhash.radii(4, 2) == [0, 0, 0, -1] and simhash.radii(1, 2) == [2]
    for segments in (1, 2, 3, 4):
        assert sorted(b for bits in simhash.segment_bits(segments) for b in bits) == list(range(64))
    assert len(simhash.ball(range(32), 1)) == 33 and len(simhash.ball(range(64), 2)) == 1 + 64 + 64 * 63 // 2


def test_star_of_many_links(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 3000)] + [(2999, 5000), (7000, 7001)], "u long, v long")
    roots = {r.node: r.root for r in simhash.connected_components(edges).collect()}
    assert all(roots[i] == 0 for i in range(3000)) and roots[5000] == 0 and roots[7001] == 7000


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501)], "u long, v long")
    roots = {r.node: r.root for r in simhash.connected_components(edges).collect()}
    assert all(roots[i] == 0 for i in range(101)) and roots[501] == 500


def test_keeps_one_of_each_group(awkward):
    kept = simhash.keep_first(awkward)
    assert kept.columns == awkward.columns
    ids = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(awkward).where("doc_id is not null").collect()}
    assert set(ids) == {c for c in groups.values()}


def test_empty_table(nothing):
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_first(nothing).count() == 0


def test_unfolded_segments_are_not_broadcast(spark):
    # the planner knows the fingerprints' size only, not that of the 34 rows of each
    fps = spark.range(0, 2000).select(F.xxhash64("id").alias("fp"))
    plan = simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
