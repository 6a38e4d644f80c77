from sonaria.llm import common, lines, simhash


def test_lines_of_rows_without_ids(spark):
    banner = "Common banner"
    rows = [(None, f"{banner}\nown {i}", f"s{i}") for i in range(6)] + [(None, f"clean {i}\nlast {i}", "s1") for i in range(3)]
    rows += [(7, f"{banner}\nx", "s2"), (7, "first y\nsecond y", "s3"), (7, f"{banner}\nx", "s2")]
    got = [r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    assert sum(banner in t for t in got) == 1
    want = [t.replace(f"{banner}\n", "") for _, t, _ in rows]
    assert sorted(t.replace(f"{banner}\n", "") for t in got) == sorted(want)


def test_first_of_rows_without_ids(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(60)) for p in "abc")
    rows = [(1, a), (1, a), (2, b), (2, a), (None, b), (None, c), (None, c)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, a), (2, b), (None, c)], key=str)


def test_a_line_on_a_third_of_all_rows_without_broadcasts(spark, monkeypatch):
    rows = [(i, "\n".join((["hot line"] if i % 3 == 0 else []) + [f"own {i}", f"pair {i // 2}", f"wide {i % 40}"]), f"s{i % 7}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(tuple, lines.dedup_lines(docs, counts=True).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common.small, "__defaults__", (0,))
    plan = lines._met(lines.lines_of(docs, "doc_id", "text", "source"), lines.lines_of(docs, "doc_id", "text", "source").groupBy("h", "h2").count())
    assert "__salt" in plan._jdf.queryExecution().toString()
    assert sorted(map(tuple, lines.dedup_lines(docs, counts=True).collect())) == want
    seen, left = set(), 0
    for r in want:
        left += r.count("hot line") if isinstance(r, str) else sum("hot line" in str(x) for x in r)
        seen.add(r[0])
    assert left == 1 and len(seen) == 3000
