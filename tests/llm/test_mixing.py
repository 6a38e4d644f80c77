import os
import re
from collections import defaultdict

import pytest

from sonaria.llm import mixing

SF = "/root/testdata/sf0.001"

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """sizes: {source: words}; sources by code point, null last, weigh 5, 2, 1, repeating."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix_against_brute_force(awkward, rows_of):
    got = mixing.mix(awkward).collect()
    sizes = defaultdict(int)
    for _, t, s in rows_of:
        sizes[s] += len(WORD.findall(t or ""))
    assert sorted(((r.doc_id, r.source, r.size, r.source_size) for r in got), key=str) == sorted(((i, s, len(WORD.findall(t or "")), sizes[s]) for i, t, s in rows_of), key=str)
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.02 * t + 20
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(awkward).collect()))


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 500, None: 70}, {"a": 1}, {"b": 0, "a": 0}, {"x": 5, "y": 0, "z": 99}, {chr(97 + i): 3**i % 101 for i in range(20)}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.capped_targets(df).collect()}
        want = brute_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_schedule_is_even(spark):
    targets = spark.createDataFrame([(0, 5000.0), (1, 3000.0), (2, 1995.0)], "number long, target double")
    rows = sorted((r.slot, r.number, r["rank"], r["first"], r["last"]) for r in mixing.schedule(targets, 10).collect())
    assert len(rows) == len({r[0] for r in rows}) == 1000
    seen = defaultdict(int)
    share = {0: 0.5, 1: 0.3, 2: 0.2}
    for n, (_, s, rank, first, last) in enumerate(rows, 1):
        assert rank == seen[s] and first == 10 * rank and last == (1995 if (s, rank) == (2, 199) else first + 10)
        seen[s] += 1
        assert all(abs(seen[x] - share[x] * n) < 8 for x in share)
    assert dict(seen) == {0: 500, 1: 300, 2: 200}


def test_slots_of_the_documents(awkward):
    """Each document is first taken by the earliest of the slots whose block holds one of its words."""
    got = mixing.mix(awkward, block=7).collect()
    assert all((r.first_slot == -1) == (r.taken == 0) for r in got)
    assert len({r.first_slot for r in got if r.taken}) > 5


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_query_matches_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(mixing.ORACLE_SQL).df()
    got = mixing.op10_query(spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = lambda f: sorted(map(str, f[order].astype(object).where(f[order].notna(), None).values.tolist()))
    assert [eval(r) for r in rows(got)] == [eval(r) for r in rows(want)]


def test_documents_of_the_mix(awkward, nothing):
    made = mixing.mixed_documents(awkward)
    assert made.columns == awkward.columns
    assert made.count() > 0
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
