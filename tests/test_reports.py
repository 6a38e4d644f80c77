"""Reports, history compression and keyword lines against plain computations."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sonaria.operators import rules as R
from sonaria.operators import text as T


def compressed(messages, trigger, kept=6):
    """The definition, message by message."""
    cost = lambda s: 8 if s == "" else len(s) // 4 + 9
    rows = [[i, cost(t), "whole", role == "tool" and len(t) > 200] for i, role, t in messages]
    if sum(r[1] for r in rows) <= trigger:
        return rows
    for r in rows:
        if sum(x[1] for x in rows) <= trigger:
            break
        if r[3]:
            r[1:3] = [len(T.BLANK) // 4 + 9, "blanked"]
    if sum(r[1] for r in rows) > trigger and len(rows) > kept + 1:
        for r in rows[:-kept]:
            r[1:3] = [0, "summarised"]
    return rows


def test_history_is_that_of_the_loop(spark):
    rng = random.Random(1)
    sessions = {s: [(i * 2, rng.choice(["user", "tool", "tool", "assistant"]), "x" * rng.choice([0, 5, 150, 250, 900])) for i in range(n)] for s, n in enumerate([1, 6, 7, 8, 20, 40, 300])}
    rows = [(s, i, role, text or None) for s, m in sessions.items() for i, role, text in m]
    df = spark.createDataFrame(rows, "session_id long, id long, role string, content string").withColumn("__before", F.lit(1))
    for trigger in (100, 1200, 3000, 10_000_000):
        got = {(r[0], r[1]): (r[2], r[3]) for r in T.compress_history(df, trigger).collect()}
        want = {(s, r[0]): (r[2], r[1]) for s, m in sessions.items() for r in compressed(m, trigger)}
        assert got == want


def test_ends_that_repeat(spark):
    part = "".join(chr(97 + i % 26) for i in range(160))
    texts = [None, "", part * 3, part * 4, "y" * 640, "y" * 639, part * 3 + "z" * 200, "head " * 60 + (part + ".") * 4, "\\E" * 400]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", R.suffix_stuck(F.col("t")).alias("s"), R.suffix_repeats(F.col("t")).alias("n")).orderBy("i").collect()
    count = lambda t: sum(t.startswith(t[-160:], i) for i in range(len(t) - min(160, len(t)) + 1))
    assert [r["s"] for r in rows] == [t is not None and len(t) >= 640 and count(t) >= 4 for t in texts]
    assert [r["n"] for r in rows[2:]] == [count(t) for t in texts[2:]]


def test_keyword_lines(spark):
    texts = [None, "", "hello", "I think a b-c dd ee\nKeys: soft pads warm x9", "just two\none", "the dog the cat dog bird\nLicense", "词 alpha beta gamma。", "a" * 50 + ": one two three", "\n".join(["no"] * 2000 + ["end of it all"])]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("value", F.lit("clash"))
    got = [r["value"] for r in T.sanitize_keywords(df, "i", "t", ["think"], ["the"]).orderBy("i").collect()]
    assert got == ["", "", "hello", "soft pads warm x9", "just two one", "the dog the cat dog bird", "alpha beta gamma", "a" * 50 + " one two three", "end of it all"]


def test_registration_states(spark):
    libraries = spark.createDataFrame([(1, "A/x", True, None), (2, "A/y", True, "Why;ABC"), (3, "A/z", True, "Zed"), (4, "B/q", False, ""), (5, "B/r", True, "Key5"), (6, "B/s", True, "None")], "id int, path string, has_nicnt boolean, product_key string")
    products = spark.createDataFrame([("Ex", "A/x"), ("WHY", "A/y/in"), ("zed", "C/other"), ("Key5", "B/r")], "reg_key string, content_dir string")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "reg_key string")
    state = lambda *more: {r["id"]: r["status"] for r in R.registration(libraries, products, *more).collect()}
    assert state() == {1: "registered", 2: "registered", 3: "path-mismatch", 4: "non-standard", 5: "registered", 6: "missing"}
    assert state(keys("ex", "why"), keys("EX", "key5")) == {1: "registered", 2: "pending-manager", 3: "path-mismatch", 4: "non-standard", 5: "incomplete", 6: "missing"}


def test_snapshots_newest_first(spark):
    full = json.dumps({"created_at": "t1", "reason": "r", "registry": {"a": {"p": {"d": "x"}, "q": {}}, "b": {"p": {}}}, "settings": "x"})
    rows = spark.createDataFrame([("s1", "m1", full), ("s3", "m3", "{"), ("s2", "m2", json.dumps({"created_at": "t2"})), ("s0", "m0", None)], "name string, modified string, content string")
    assert [tuple(r) for r in R.snapshots(rows).collect()] == [("s3", "m3", "", 0, False), ("s2", "t2", "", 0, False), ("s1", "t1", "r", 3, True), ("s0", "m0", "", 0, False)]


def test_suggestions_without_findings_and_with_nulls(spark):
    form = "id int, name string, category string, has_nicnt boolean, cover_file string, junk_bytes long"
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    pairs = spark.createDataFrame([], "a int, b int, jaccard double")
    none = {"unregistered": ids(), "no-kb": ids()}
    assert R.suggestions(spark.createDataFrame([], form), none, pairs).count() == 0
    rows = spark.createDataFrame([(1, "one", "c", True, "x", 0), (2, None, None, True, None, None), (3, "two", " ", False, "", 200 << 20)], form)
    some = R.suggestions(rows, {"unregistered": ids(2, 2), "no-kb": ids(1)}, spark.createDataFrame([(1, 3, 0.9)], "a int, b int, jaccard double"))
    assert [tuple(r) for r in some.collect()] == [("register", 1, 1_000_001, ""), ("kb", 1, 900_001, "one"), ("similar", 1, 700_001, "one,two"), ("junk", 1, 600_200, "two"), ("cover", 1, 300_001, ""), ("nonstandard", 1, 200_001, "two"), ("unclassified", 2, 100_002, ",two")]
