"""Listings, nested reports, merged bases, moves and plans against plain computations."""

import json
import random
from collections import defaultdict

from pyspark.sql import functions as F

from sonaria.operators import bases, listing, moves, nested, rules
from sonaria.sources import tables


def test_scan_jobs(spark):
    roots = spark.createDataFrame([("A", True), ("A", True), ("B", False), ("C", True), (None, True), ("D", None)], "path string, enabled boolean")
    files = spark.createDataFrame([("A", "x/1.wav"), ("A", "x\\y/2.wav"), ("A", "/z//3.wav"), ("A", "top.wav"), ("A", None), ("A", ""), ("B", "x/1.wav"), ("D", "x/1"), (None, "x/1")], "root_path string, rel_path string").withColumn("path", F.lit("clash"))
    got = sorted(tuple(r) for r in listing.scan_jobs(roots, files).collect())
    assert got == [("A", "x", "A/x", 2), ("A", "z", "A/z", 1)]
    assert listing.scan_jobs(roots, files.limit(0)).count() == 0


def test_directory_listing_is_that_of_a_walk(spark):
    rng = random.Random(3)
    paths = ["/".join(rng.choice("abC") + rng.choice(["", "x"]) for _ in range(rng.randint(1, 11))) for _ in range(400)]
    rows = [(p, rng.choice([1, 5, 5, 9])) for p in paths] + [(None, 3), ("", 3)]
    df = spark.createDataFrame(rows, "path string, size long").withColumn("kind", F.lit("clash"))
    known = [(p.split("/"), s) for p, s in rows if p]
    for folder, pattern, recursive, most in [("", "", True, 10_000), ("", "*X", True, 7), ("a/cx", "", True, 50), ("A", "c*", False, 50), ("none", "", True, 5)]:
        base = [x for x in folder.lower().split("/") if x]
        below = [(p[len(base) :], s) for p, s in known if len(p) > len(base) and [x.lower() for x in p[: len(base)]] == base]
        deep = 7 if recursive else 1
        fits = lambda name: not pattern or (name.lower().endswith("x") if pattern == "*X" else name.lower().startswith("c"))
        dirs = sorted({"/".join(p[:n]) for p, _ in below for n in range(1, min(len(p) - 1, deep) + 1) if fits(p[n - 1])})
        found = sorted((-s, "/".join(p)) for p, s in below if len(p) <= deep and fits(p[-1]))
        want = [("folder", d, 0, len(dirs)) for d in dirs[:most]] + [("file", n, -s, len(found)) for s, n in found[:most]]
        assert [tuple(r) for r in listing.directory_listing(df, "path", "size", folder, pattern, recursive, most=most).collect()] == want


def test_nested_blocks_hold_all_of_a_large_group(spark):
    rng = random.Random(7)
    rows = [(i, 1 if i % 3 else i % 20, rng.choice(["a", "b", None]), rng.choice([True, False, None])) for i in range(3000)] + [(9000, None, "x", True)]
    manuals = spark.createDataFrame(rows, "id long, library_id long, name string, is_primary boolean").repartition(6)
    libraries = spark.createDataFrame([(1, "L1", "c"), (3, "L3", " "), (6, None, None)], "id long, name string, category string")
    base = spark.createDataFrame([(1, 4, 12), (3, 5, 0), (6, None, 2)], "library_id long, manual_id long, pages int")
    got = nested.manuals_tree(manuals, libraries, base, 50).collect()
    held = defaultdict(list)
    for r in got:
        assert len(r["items"]) <= 50 and r["block"] * 50 == len(held[r["library_id"]])
        held[r["library_id"]] += [tuple(x) for x in r["items"]]
    for lib in {r[1] for r in rows} - {None}:
        own = sorted((not p, n is not None, n or "", i, bool(p)) for i, x, n, p in rows if x == lib for p in [bool(p)])
        assert held[lib] == [(i, n if has else None, p, i == 4 and lib == 1, 12 if i == 4 and lib == 1 else 0) for _, has, n, i, p in own]
    heads = {(r["library_id"], r["category"], r["library_name"], r["manuals"], r["built"]) for r in got if r["library_id"] in (1, 3, 6)}
    assert {h[0]: h[1:] for h in heads} == {1: ("c", "L1", len(held[1]), True), 3: ("uncategorised", "L3", len(held[3]), False), 6: ("uncategorised", "", len(held[6]), True)}
    assert [tuple(r) for r in nested.manuals_tree_totals(manuals, base).collect()] == [(3000, len(held[1]) + len(held[6]), len(held))]
    assert nested.manuals_tree(manuals.limit(0), libraries, base).count() == 0


def test_sessions_tree(spark):
    rows = [(i, [None, "", "b", "a"][i % 4], i % 5 or None, i) for i in range(60)]
    got = nested.sessions_tree(spark.createDataFrame(rows, "session_id long, category string, updated_at long, messages long"), 8).collect()
    held = defaultdict(list)
    for r in got:
        held[r["category"]] += [x["session_id"] for x in r["items"]]
    for name, mine in held.items():
        own = [(-(u or 0), s) for s, c, u, _ in rows if (c or "uncategorised") == name]
        assert mine == [s for _, s in sorted(own)]
    assert [r["category"] for r in got] == ["a"] * 2 + ["b"] * 2 + ["uncategorised"] * 4 and {r["newest"] for r in got} == {4}


def test_merged_bases(spark):
    form = "library_id long, library_name string, manual_name string, pages array<struct<n:int,text:string>>, chunks array<struct<id:int,page:int,text:string>>, overview string, built_at long"
    rows = [(3, "C", "m", [(1, "abc"), (2, None)], [(7, 1, "t1"), None, (8, 2, None)], "o" * 250, 5), (1, None, "m", None, None, None, 9), (2, "B", "m", [], [(1, 4, "u")], "", 1), (5, "E", "m", [(1, "")], [(0, 0, "z")] * 3, "say", 5)]
    df = spark.createDataFrame(rows, form)
    assert [tuple(r) for r in bases.merged_chunks(df).orderBy("id").collect()] == [(1, 2, 4, "[B] u"), (2, 3, 1, "[C] t1"), (3, 3, 2, "[C] "), (4, 5, 0, "[E] z"), (5, 5, 0, "[E] z"), (6, 5, 0, "[E] z")]
    assert [r["text"][:7] for r in bases.merged_overview(df).collect()] == ["[C] ooo", "[E] say"]
    assert tuple(bases.merged_totals(df).first())[:3] == (4, 3, 3)
    assert tuple(bases.merged_totals(df.limit(0)).first()) == (0, 0, 0, 0, 0) and bases.merged_chunks(df.limit(0)).count() == 0
    names = spark.createDataFrame([(3, "C", "k"), (2, "B", "k"), (5, "E", None), (1, "A", "k")], "id long, name string, category string")
    got = bases.catalog(df, names).collect()
    assert [(r["library_id"], r["page_count"], r["total_chars"], len(r["overview"])) for r in got] == [(3, 2, 3, 241), (5, 1, 0, 3)]


def test_moves(spark):
    libraries = spark.createDataFrame([(1, "One", "A/One", 1000, 3, True, "K1"), (2, "Two", "A/Two", 10**12, 4, False, "K2"), (3, "Gone", "A/Gone", 0, 0, True, None), (4, "Four", "B\\Four\\", 10, 1, False, None)], "id int, name string, path string, size_bytes long, file_count int, has_nicnt boolean, product_key string")
    roots = spark.createDataFrame([("A/",), ("B",)], "path string")
    folders = spark.createDataFrame([("A/One",), ("A/Two",), ("B/Four/in",), ("B/TWO",), ("C/x",), (None,)], "path string")
    free = spark.createDataFrame([("A", 10**9), ("b/", 10**9)], "path string, free_bytes long")
    products = spark.createDataFrame([("k1", "A/One/sub"), ("Z", "a/one"), ("Y", "A/Ones"), (None, "A/One"), ("F", "B/Four")], "reg_key string, content_dir string")
    plan = [(1, "B"), (2, "B"), (3, "C"), (4, "Nowhere"), (1, "A/One"), (9, "B"), (4, "B/four"), (4, "B"), (1, None)]
    got = moves.move_plans(spark.createDataFrame(plan, "library_id int, dest_root string"), libraries, roots, folders, free, products, admin=False).collect()
    said = {(r["library_id"], r["dest_root"]): (r["products"], r["errors"], r["warnings"]) for r in got}
    admin = ["not-admin"]
    assert said == {
        (1, "B"): (2, [], admin),
        (2, "B"): (0, ["exists", "no-space"], [*admin, "no-products"]),
        (3, "C"): (1, ["no-source"], ["unknown-root", "free-space-unknown", *admin]),
        (4, "Nowhere"): (1, ["no-dest-root"], admin),
        (1, "A/One"): (2, ["nested"], ["unknown-root", "free-space-unknown", *admin]),
        (9, "B"): (0, ["no-library"], []),
        (4, "B/four"): (1, ["nested"], ["unknown-root", "free-space-unknown", *admin]),
        (4, "B"): (1, ["exists"], admin),
        (1, None): (2, ["no-dest-root"], admin),
    }


def test_orphans(spark):
    products = spark.createDataFrame([("A", "x/y", True, True), ("b", "gone", True, None), ("C", "gone", True, True), ("D", "", True, True), ("E", None, True, True), ("F", "X", True, True), ("G", "lost/", False, True)], "reg_key string, content_dir string, v1 boolean, v2 boolean")
    folders = spark.createDataFrame([("x/y/z",)], "path string")
    index = spark.createDataFrame([("B",), ("b",), ("A",)], "reg_key string")
    hints = spark.createDataFrame([("g", "<T>yes</T>"), ("B", "<T>yes</T>"), ("C", "<T>no</T>"), ("C", None)], "reg_key string, body string")
    got = sorted(tuple(r) for r in moves.orphan_products(products, folders, index, hints, ["<T>yes</T>"], ["v1", "v2"]).collect())
    assert got == [("v1", "b", "gone", "index"), ("v2", "G", "lost/", "hint")]


def test_plan_steps(spark):
    texts = [None, "", "{", "{}", "[]", '[" a ", {"title": " b ", "status": "done "}, {"title": " "}, {"status": "done"}, {"title": "c", "status": "no"}, 5, null, ["x"], "", {"title": "d", "status": null}]', json.dumps([{"title": ""}] * 30 + ["s"] * 30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", rules.plan_steps(F.col("t")).alias("s")).orderBy("i").collect()
    got = [None if r["s"] is None else [tuple(x) for x in r["s"]] for r in rows]
    assert [g or [] for g in got[:5]] == [[]] * 5
    assert got[5] == [("a", "pending"), ("b", "done"), ("c", "pending"), ("", "pending"), ("d", "pending")]
    assert got[6] == [("s", "pending")] * 20


def test_csv_with_a_mark(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = [("", 'a "b", c', 1), ("é", "d\ne", 2), (None, "plain", 3)]
    tables.write_csv(spark.createDataFrame(rows, "lib string, file string, n int").coalesce(1), path, mark=True)
    data = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert data.decode("utf-8") == '﻿lib,file,n\n,"a ""b"", c",1\né,"d\ne",2\n,plain,3\n'
