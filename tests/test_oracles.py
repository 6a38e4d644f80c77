"""Every catalog query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from sonaria.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(frame):
    def cell(v):
        if v is None or v != v:
            return "-"
        return repr(round(float(v), 6)) if isinstance(v, float) and not math.isinf(v) else str(v)

    return sorted("|".join(cell(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_queries_match_their_sql(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    queries, oracles = registry.queries(), registry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 180
    wrong = []
    for name, run in queries.items():
        got = run(spark, SF).toPandas()
        if name in oracles:
            want = con.sql(oracles[name]).df()
            if sorted(got.columns) != sorted(want.columns) or normal(got) != normal(want):
                wrong.append(name)
    assert not wrong
