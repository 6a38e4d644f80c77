from collections import defaultdict

from sonaria.llm import mixing


def test_small_sources_meet_their_targets(spark):
    rows = [(i, "word " * 9000, "big") for i in range(400)] + [(1000 + i, "a b c", f"small{i % 20}") for i in range(60)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size
    assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items())


def test_many_small_sources_beside_a_large_one(spark):
    rows = [(i, "word " * 2000, "big") for i in range(300)] + [(10_000 + i, "a b c d e", f"s{i % 2000:04}") for i in range(6000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), block=64).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(target) == 2001 and all(abs(taken[s] - t) <= 0.5 for s, t in target.items())
