"""Name joins, product keys, diverse candidates, commits, resumed work, repeated calls, stored files."""

import hashlib
import random
from collections import Counter, deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sonaria.operators import containment, dedup, diverse, rules
from sonaria.operators.relational import numbered, spread_places
from sonaria.sources import commits
from sonaria.sources.commits import Collection, Conflict
from sonaria.streaming import repeats

# names


def names(seed, n, most):
    r = random.Random(seed)
    return ["".join(r.choice("abcé") for _ in range(r.randrange(0, most))) for _ in range(n)] + [None, "", "a", "abcabc"]


@pytest.mark.parametrize("least", [1, 3, 4, 5])
def test_containment_is_that_of_all_pairs(spark, least):
    a, b = names(1, 80, 7), names(2, 120, 12)
    left, right = spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x, 1) for x in b], "b string, a int")
    fits = [(x, y) for x in {*a} - {None} for y in {*b} - {None} if len(x) >= least and len(y) >= least]
    got = [tuple(r) for r in containment.contained(left, "a", right, "b", least).collect()]
    assert Counter(got) == Counter((x, y) for x, y in fits if x in y)
    got = [tuple(r) for r in containment.either_contains(left, "a", right, "b", least).collect()]
    assert Counter(got) == Counter((x, y) for x, y in fits if x in y or y in x)


def test_ends_are_those_of_all_pairs(spark):
    a, b = names(3, 60, 5), names(4, 60, 9)
    got = containment.either_ends(spark.createDataFrame([(x,) for x in a], "a string"), "a", spark.createDataFrame([(x,) for x in b], "b string"), "b").collect()
    assert Counter(map(tuple, got)) == Counter((x, y) for x in {*a} - {None, ""} for y in {*b} - {None, ""} if x.endswith(y) or y.endswith(x))


def test_a_common_gram_makes_no_pairs(spark):
    a = spark.createDataFrame([(f"common {i:05}x",) for i in range(2000)], "a string")
    b = spark.createDataFrame([(f"common {i:05}y",) for i in range(2000)], "b string")
    assert containment.contained(a, "a", b, "b", 4).count() == 0


def test_hints_equal_before_contained(spark):
    libraries = spark.createDataFrame([(1, "Grand Piano II", None), (2, "x", "Vol-Strings!"), (3, "Cello", "abc"), (4, None, None), (5, "nothing here", "zzz"), (6, "strings", "Grand Piano")], "id int, name string, key string")
    hints = spark.createDataFrame([(1, "Piano"), (2, "grand piano ii"), (3, "strings"), (4, "Cello Solo Edition"), (5, ""), (6, "ab"), (7, None), (8, "STRINGS")], "hint int, name string")
    got = {r.id: (r.hint, r.how) for r in containment.find_hints(libraries, hints).collect()}
    assert got == {1: (2, "equal"), 2: (3, "contains"), 3: (4, "contains"), 6: (3, "equal")}


def test_product_keys_by_three_ways(spark):
    libraries = spark.createDataFrame([(1, "Acme Big Strings", "/a/big"), (2, "Studio Brass Ensemble", "/a/brass"), (3, "Brass", "/a/b"), (4, "other", "/a/big2")], "id int, name string, path string")
    products = spark.createDataFrame([("K path", "/a/big/content"), ("K too", "/a/big"), ("Brass Ensemble", "/elsewhere"), ("Brass", "/lost"), ("My Studio Brass Ensemble", None)], "reg_key string, content_dir string")
    containers = spark.createDataFrame([(2, "BRASS ensemble"), (2, "own"), (3, ""), (4, None), (1, "boxed")], "id int, key string")
    got = {tuple(r) for r in containment.product_keys(libraries, products, containers, ["Acme "]).collect()}
    assert got == {(1, "K path", "path"), (1, "K too", "path"), (1, "boxed", "container"), (2, "Brass Ensemble", "name"), (2, "My Studio Brass Ensemble", "name"), (2, "own", "container"), (3, "Brass Ensemble", "name"), (3, "My Studio Brass Ensemble", "name")} - {(3, "Brass Ensemble", "name"), (3, "My Studio Brass Ensemble", "name")}


def test_related_words_of_the_first_family(spark):
    families = spark.createDataFrame([(0, "drum", ["snare", "kick"]), (1, "drums", ["tom"]), (2, "pad", ["drone", "pad x"]), (3, "hat", ["ride"])], "rank int, word string, related array<string>")
    terms = spark.createDataFrame([(" Drums ",), ("dru",), ("soft pad x",), ("hat",), ("",), (None,), ("none",)], "term string")
    assert {r.term: r.related for r in containment.related_terms(terms, families).collect()} == {"drums": ["snare", "kick"], "dru": ["snare", "kick"], "soft pad x": ["drone"], "hat": ["ride"]}


# places


def test_places_of_long_keys(spark):
    r = random.Random(3)
    rows = [("hot", i) for i in range(5000)] + [(f"k{i % 50}", i) for i in range(500)] + [(None, 7), (None, 3)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int").repartition(6)
    by = {}
    for k, o in sorted(rows, key=lambda x: (str(x[0]), x[1])):
        by.setdefault(k, []).append(o)
    got = {(x.k, x.o): x.place for x in spread_places(df.where("k is not null"), "k", "o").collect()}
    assert got == {(k, o): i + 1 for k, os in by.items() if k for i, o in enumerate(os)}
    assert [(x.o, x.n) for x in numbered(df.where("k = 'hot'"), "o", "n", 100).orderBy("o").collect()] == [(i, 101 + i) for i in range(5000)]


# diverse picks


def test_core_sets_are_as_far_apart_as_the_greedy_choice(spark):
    m = np.random.default_rng(5).standard_normal((900, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(1000, None), (1001, [1.0])], "vec_id long, embedding array<double>")
    exact = diverse.greedy(np.arange(900), m / np.linalg.norm(m, axis=1, keepdims=True), 8)
    one = [(r.vec_id, round(r.distance, 6)) for r in diverse.core_set(df.coalesce(1), 8).orderBy("pick").collect()]
    assert one == [(p, round(d, 6)) for p, d in zip(*exact)]
    many = diverse.core_set(df.repartition(7), 8).collect()
    assert len(many) == 8 and min(r.distance for r in many) >= 0.5 * min(exact[1])
    assert diverse.core_set(df.limit(0), 8).count() == 0 and diverse.core_set(df, 99).count() == 12


def frame(rows):
    return pd.DataFrame(rows, columns=["id", "library_id", "strong", "vec"])


def test_choice_keeps_guarantees_and_quotas():
    e = lambda *x: list(map(float, x))
    rows = [(1, 10, True, e(1, 0)), (2, 10, True, e(1, 0.1)), (3, 20, True, None), (4, 30, False, e(0, 1)), (5, 10, False, e(-1, 0)), (6, 40, False, e(0.9, 0.1)), (7, 50, False, None)]
    got = diverse.choose(frame(rows), 4, 2)
    # 1 and 3 are guaranteed (2 shares a library); 3 has no vector, so all are equally far, and the first of a new library is 4, then 6
    assert got["id"].tolist() == [1, 3, 4, 6] and got["matched"].tolist() == ["name", "name", "path", "path"]
    assert got["diversity"].round(6).tolist()[1] == 0.0
    # without a guarantee the farthest counts: 5 is the farthest from 1 but of its library, so 4 comes before it
    got = diverse.choose(frame([r for r in rows if r[3]]), 3, 0)
    assert got["id"].tolist() == [1, 4, 6]
    assert diverse.choose(frame(rows[:1]), 3, 1)["diversity"].tolist() == [1.0]
    assert len(diverse.choose(frame([(9, 1, False, None)]), 3, 0)) == 0


def test_diverse_candidates_of_a_question(spark):
    clips = [(i, i % 5, f"Snare {i} {'room' if i % 7 == 0 else 'close'}", f"lib{i % 5}/x", "wav", "sample") for i in range(40)] + [(100 + i, 9 + i, f"kick {i}", "snare/y", "wav", "sample") for i in range(3)] + [(200, 50, "tom 1", "z", "wav", "sample")]
    df = spark.createDataFrame(clips, "id long, library_id long, name string, rel_path string, ext string, kind string")
    vec = spark.createDataFrame([(i, [float(i % 3), float(i % 5), 1.0]) for i, *_ in clips if i % 4], "id long, vec array<double>")
    got = diverse.diverse_candidates(df, vec, "snare", 9, 3, 2, related=["kick", "tom"]).orderBy("pick").collect()
    assert len({r.library_id for r in got}) == 9 and sum(r.matched == "name" for r in got[:3]) == 3
    assert any(r.matched == "name:tom" and r.library_id == 50 for r in got)
    assert all(1 <= len(r.companions) <= 2 for r in got)
    assert [tuple(r) for r in got] == [tuple(r) for r in diverse.diverse_candidates(df, vec, "snare", 9, 3, 2, related=["kick", "tom"]).orderBy("pick").collect()]
    assert diverse.diverse_candidates(df, vec, "no such words", 3, 1, 2).count() == 0


# commits


def test_readers_see_all_of_a_commit_or_none(spark, tmp_path, monkeypatch):
    store = Collection(spark, f"file://{tmp_path}/c")
    assert store.read("a") is None and store.versions() == []
    one = spark.range(3).toDF("id")
    store.commit({"a": one, "b": one})
    real = Collection._publish

    def stopped(self, *args):
        raise RuntimeError("stopped")

    monkeypatch.setattr(Collection, "_publish", stopped)
    with pytest.raises(RuntimeError):
        store.commit({"a": spark.range(9).toDF("id"), "b": spark.range(8).toDF("id")})
    assert (store.read("a").count(), store.read("b").count(), store.versions()) == (3, 3, [1])
    broken = one.select(F.raise_error(F.lit("stop")).cast("long").alias("id"))
    monkeypatch.setattr(Collection, "_publish", real)
    with pytest.raises(Exception, match="stop"):
        store.commit({"a": spark.range(9).toDF("id"), "b": broken})
    assert (store.read("a").count(), store.read("b").count()) == (3, 3)
    assert len(store.clean()) >= 3 and store.read("a").count() == 3
    assert store.commit({"a": spark.range(9).toDF("id")}) == 2
    assert (store.read("a").count(), store.read("b").count(), store.read("a", 1).count()) == (9, 3, 3)
    with pytest.raises(Conflict):
        store.commit({"a": one}, since=1)
    with pytest.raises(Conflict):
        store._publish(2, {"version": 2, "tables": {}})
    assert store.read("a").count() == 9


def test_a_scan_replaces_its_roots_only(spark, tmp_path):
    store = Collection(spark, f"file://{tmp_path}/c")
    libs = lambda *rows: spark.createDataFrame(rows, "root_path string, path string, size long")
    held = lambda *rows: spark.createDataFrame(rows, "library_path string, name string")
    roots = spark.createDataFrame([("/r1", "one"), ("/r2", "two")], "path string, label string")
    commits.save_scan(store, roots, libs(("/r1", "/r1/a", 1), ("/r1", "/r1/b", 2), ("/r2", "/r2/c", 3)), {"instruments": held(("/r1/a", "i"), ("/r1/b", "j"), ("/r2/c", "k"))}, {"n": 1})
    first = {r.path: r.id for r in store.read("libraries").collect()}
    again = spark.createDataFrame([("/r1", "renamed"), ("/r3", "three")], "path string, label string")
    commits.save_scan(store, again, libs(("/r1", "/r1/a", 9), ("/r3", "/r3/d", 4)), {"instruments": held(("/r1/a", "new"), ("/r3/d", "x"))}, {"n": 2})
    assert sorted((r.path, r.label, r.id) for r in store.read("roots").collect()) == [("/r1", "renamed", 1), ("/r2", "two", 2), ("/r3", "three", 3)]
    now = {r.path: (r.size, r.id) for r in store.read("libraries").collect()}
    assert {k: v[0] for k, v in now.items()} == {"/r1/a": 9, "/r2/c": 3, "/r3/d": 4} and now["/r2/c"][1] == first["/r2/c"]
    assert len({v[1] for v in now.values()}) == 3 and now["/r1/a"][1] > max(first.values())
    owner = {v[1]: k for k, v in now.items()}
    assert sorted((owner[r.library_id], r.name) for r in store.read("instruments").collect()) == [("/r1/a", "new"), ("/r2/c", "k"), ("/r3/d", "x")]
    assert store.read("runs").count() == 2


def test_work_goes_on_after_a_stop(spark, tmp_path):
    store = Collection(spark, f"file://{tmp_path}/f")
    jobs = spark.createDataFrame([(i,) for i in [*range(25), 3, 4]], "clip_id long")
    turns = []

    def work(part):
        turns.append(part.count())
        if len(turns) == 3:
            return part.select("clip_id", F.raise_error(F.lit("broken")).cast("long").alias("v"))
        return part.select("clip_id", (F.col("clip_id") * 2).alias("v"))

    with pytest.raises(Exception, match="broken"):
        commits.extract(store, jobs, work, batch=10)
    assert store.read("features").count() == 20
    assert commits.extract(store, jobs, work, batch=10) == 5 and commits.extract(store, jobs, work, batch=10) == 0
    assert sorted((r.clip_id, r.v) for r in store.read("features").collect()) == [(i, 2 * i) for i in range(25)]
    assert turns == [10, 10, 5, 5]


# repeated calls


def brute_notices(rows, without, last=24):
    rings, out = {}, []
    for session, id_, tool, args in sorted({r[1]: r for r in rows}.values(), key=lambda r: r[1]):
        if tool in without:
            continue
        ring = rings.setdefault(session, deque(maxlen=last))
        fp = (tool, tuple(sorted(args.items())))
        ring.append(fp)
        if (n := ring.count(fp)) in repeats.NOTICES:
            out.append((session, id_, n))
    return sorted(out)


def trace(seed, n):
    r = random.Random(seed)
    return [(r.choice([1, 1, 1, 2, 3]), i, r.choice(["read", "list", "note"]), {"a": r.randrange(2), "b": r.randrange(2)}) for i in range(n)]


def trace_frame(spark, rows):
    text = lambda i, a: "{" + (", ", ",")[i % 2].join(f'"{k}":{" " * (i % 3)}{v}' for k, v in a.items()) + "}"
    return spark.createDataFrame([(s, i, t, text(i, a)) for s, i, t, a in rows], "session_id long, id long, tool_name string, args string")


@pytest.mark.parametrize("block", [40, 4096])
def test_notices_of_a_table(spark, block):
    rows = trace(1, 1200)
    got = repeats.repeat_notices(trace_frame(spark, [*rows, *rows[:50]]), ["note"], block=block).collect()
    assert sorted(map(tuple, got)) == brute_notices(rows, {"note"}) and len(got) > 100


def test_notices_of_a_stream_with_repeated_and_late_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rows = trace(2, 300)
    parts = [rows[:100], rows[100:200], rows[50:150], rows[200:], rows[:20]]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, part in enumerate(parts):
        trace_frame(spark, part).coalesce(1).write.parquet(f"{source}/p={i}")
        stream = spark.readStream.schema("session_id long, id long, tool_name string, args string, p int").option("recursiveFileLookup", "false").parquet(source)
        query = repeats.repeat_stream(stream, ["note"]).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        ended = query.awaitTermination(60)
        query.stop()
        assert ended and query.exception() is None
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    got = sorted((r.session_id, r.id, r.repeats) for r in spark.read.parquet(out).collect())
    assert got == brute_notices(rows, {"note"})


# stored files and rules


def test_stored_files_are_read_at_their_ends_only(spark, tmp_path):
    r = random.Random(1)
    body = r.randbytes(3000)
    files = {"a/one.wav": body, "b/two.wav": body, "b/middle.wav": body[:1500] + b"x" + body[1501:], "a/other.wav": r.randbytes(3000), "a/short.wav": body[:900], "b/short.wav": body[:900], "a/alone.wav": r.randbytes(2000), "a/same.wav": body[:777] * 2, "a/same2.wav": body[:777] * 2, "b/tiny": b"t", "a/tiny": b"t"}
    listing = []
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
        listing.append((f"file://{tmp_path}/{name}", name[0], len(data)))
    listing += [(f"file://{tmp_path}/gone", "a", 900), ("no such store://x", "b", 900)]
    df = spark.createDataFrame(listing, "path string, library string, size_bytes long")
    got = [tuple(x) for x in dedup.duplicate_stored_files(df, least=100, head=1000, tail=500).collect()]
    ends = lambda d: hashlib.sha256(d[:1000] + (d[-500:] if len(d) > 1500 else b"")).hexdigest()
    # the middle of a long file is not read, so one byte changed there does not count
    assert got == [(ends(body), 3000, 3, 2, 6000), (ends(body[:900]), 900, 2, 2, 900)]
    read = {x.path.split("/")[-1]: x.bytes_read for x in dedup.file_digests(dedup._candidates(df, 100), 1000, 500).collect()}
    assert read["one.wav"] == 1500 and read["gone"] == 0 and "alone.wav" not in read and "same.wav" not in read and "tiny" not in read


def test_conditions_on_other_tables(spark):
    libs = spark.createDataFrame([(i, f"n{i}", "c", 0, "x", i != 4, 5, f"K{i}") for i in range(1, 6)], "id long, name string, category string, junk_bytes long, cover_file string, has_nicnt boolean, size_bytes long, product_key string")
    held = spark.createDataFrame([(1, "a"), (1, "B"), (1, "c"), (2, "A"), (2, "b"), (2, "c"), (2, "d"), (3, "a")], "library_id long, name string")
    products = spark.createDataFrame([("k1",), ("K2",), (None,)], "reg_key string")
    manuals = spark.createDataFrame([(1, "Manual", "pdf", 9_000_000, True, 5), (1, "notes", "txt", 900, False, 9), (2, "Manual", "pdf", 9_000_000, True, 5), (3, "Manual", "pdf", 9_000_000, True, 5)], "library_id long, name string, ext string, size_bytes long, is_primary boolean, mtime int")
    bases = spark.createDataFrame([(1, "Manual", 5), (2, "Manual", 4), (3, "other", 9)], "library_id long, manual_name string, built int")
    related = rules.related_ids(libs, held, products, manuals, bases)
    ids = {k: sorted(r.id for r in v.collect()) for k, v in related.items()}
    assert ids == {"duplicate": [1, 2], "unregistered": [3, 5], "no-kb": [2, 3]}
    got = {tuple(r) for r in rules.batch_rules(libs, rules.parse_batch("duplicate and no-kb: build-kb\nunregistered, name~n5: register\nno-kb and sparkling: list"), related).collect()}
    assert got == {(2, "build-kb", "", "duplicate and no-kb"), (5, "register", "", "unregistered and name~n5")}
