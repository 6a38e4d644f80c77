import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonaria.operators import dedup, diverse, relational, rules, text, vectors


def test_timbre_percentiles(spark):
    rows = []
    for i in range(100):
        v = [0.0] * 32
        v[26], v[30], v[31] = float(i), float(100 - i), float(i)
        rows.append((i, v))
    df = spark.createDataFrame(rows, "vec_id long, vec array<float>")
    dims = {"brightness": (26, False), "loudness": (30, False), "punch": (31, True)}
    got = {r.vec_id: r for r in vectors.percentiles(df, "vec_id", dims, "vec").collect()}
    assert len(got) == 100 and all(0 <= x <= 1 for r in got.values() for x in (r.brightness, r.loudness, r.punch))
    assert all(got[i].brightness < got[i + 1].brightness and got[i].punch > got[i + 1].punch for i in range(99)) and got[99].brightness == 1
    bright = {i for i in got if got[i].brightness >= 0.5}
    assert 45 <= len(bright) <= 55 and len({i for i in bright if got[i].loudness >= 0.5}) < len(bright)
    one = vectors.percentiles(df.limit(1), "vec_id", dims, "vec").first()
    assert one.brightness == 0.5


def test_global_ranks_against_sorting(spark):
    r = random.Random(4)
    values = [float(r.randrange(20)) for _ in range(300)] + [7.0] * 200 + [None] * 5
    df = spark.createDataFrame(list(enumerate(values)), "i long, v double")
    rows = relational.global_ranks(df, "v", part_rows=10).collect()
    assert len(rows) == 505
    for row in rows:
        assert (row.less, row.n) == ((None, None) if row.v is None else (sum(x < row.v for x in values if x is not None), 500))


def test_ranks_by_group_keep_rows_without_a_value(spark):
    rows = [(i, [float(i % 5), float(-i)]) for i in range(40)] + [(40, [3.0]), (41, None), (42, [])]
    df = spark.createDataFrame(rows, "vec_id long, vec array<double>")
    got = {r.vec_id: (r.a, r.b) for r in vectors.percentiles(df, "vec_id", {"a": (0, False), "b": (1, True)}, "vec").collect()}
    assert len(got) == 43 and got[41] == got[42] == (None, None) and got[40][1] is None
    known = [v[0] for _, v in rows if v]
    assert got[7][0] == round(sum(x < 2 for x in known) / 40, 6) and got[0][1] == 0.0 and got[39][1] == 1.0


def test_first_rows_of_each_key(spark):
    rows = [(k, f"{r:03}") for k in ("a", "b") for r in range(50)] + [("c", "x"), (None, "n")]
    got = {tuple(r) for r in relational.first_rows(spark.createDataFrame(rows, "k string, r string"), ["k"], "r", 7).collect()}
    assert got == {(k, f"{r:03}") for k in ("a", "b") for r in range(7)} | {("c", "x"), (None, "n")}


@pytest.mark.parametrize("least", [0.2, 0.35, 0.8])
def test_similar_pairs_against_all_pairs(spark, least):
    r = random.Random(8)
    sets = {o: {f"n{r.randrange(12)}" for _ in range(r.randrange(1, 9))} | {"everywhere"} for o in range(40)}
    rows = [(o, n) for o, s in sets.items() for n in s for _ in range(2)] + [(3, None)]
    got = {tuple(x) for x in relational.similar_pairs(spark.createDataFrame(rows, "o long, n string"), "o", "n", least).collect()}
    want = {(a, b, len(x & y), len(x), len(y)) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) >= least * len(x | y) - 1e-9}
    assert got == want


def blobs():
    r = random.Random(42)
    pts = [(i, r.uniform(0, 2), r.uniform(0, 2)) for i in range(60)] + [(60 + i, r.uniform(100, 102), r.uniform(100, 102)) for i in range(60)]
    return pts + [(120 + i, r.uniform(20, 80), r.uniform(20, 80)) for i in range(5)]


def test_density_clusters_of_two_blobs(spark):
    df = spark.createDataFrame([(i, 0, x, y, 0) for i, x, y in blobs()], "clip_id long, library_id int, x double, y double, cluster int")
    got = {r.clip_id: r.cluster for r in vectors.dense_clusters(df, 1.0).collect()}
    assert len(got) == 125 and len({got[i] for i in range(60)}) == 1 == len({got[i] for i in range(60, 120)})
    assert got[0] != got[60] and {got[i] for i in range(120, 125)} == {"-1"}
    few = vectors.dense_clusters(df.limit(2), 1.0).collect()
    assert {r.cluster for r in few} == {"-1"}


def test_grid_cluster_partitions_the_points(spark):
    df = spark.createDataFrame([(i, 0, x, y, 0) for i, x, y in blobs()], "clip_id long, library_id int, x double, y double, cluster int")
    got = {r.clip_id: r.cluster for r in vectors.grid_cluster(df).collect()}
    assert len(got) == 125 and got[0] != got[60] and len({got[i] for i in range(60)}) == 1


def test_neighbours_and_diversity(spark):
    r = np.random.default_rng(2)
    m = r.normal(size=(80, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(80, [0.0] * 16), (81, [1.0])], "vec_id long, embedding array<double>")
    near = [x.vec_id for x in vectors.nearest(df, m[3].tolist(), 10, without=3).collect()]
    cos = m @ m[3] / np.linalg.norm(m, axis=1) / np.linalg.norm(m[3])
    assert near == [i for i in np.argsort(-cos, kind="stable") if i != 3][:10]
    picks = [x.vec_id for x in diverse.core_set(df.where("vec_id < 80").coalesce(1), 5).orderBy("pick").collect()]
    assert len(set(picks)) == 5 and picks[0] == 0
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    want = [0]
    while len(want) < 5:
        d = (1 - unit @ unit[want].T).min(axis=1)
        want.append(int(d.argmax()))
    assert picks == want


def test_mean_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0])], "g int, vec array<double>")
    got = {r.g: (r.n, r.vec) for r in vectors.mean_vectors(df, ["g"], "vec").collect()}
    assert got[1][0] == 2 and got[1][1] == pytest.approx([0.7071067] * 2) and got[2][1] == [0.0, 0.0]


def test_longest_prefix(spark):
    rows = spark.createDataFrame([("a/b/c",), ("a/bc",), ("z",), ("a",)], "p string")
    owners = spark.createDataFrame([("a", 1), ("a/b", 2)], "q string, o int")
    assert {r.p: r.o for r in relational.longest_prefix(rows, "p", owners, "q").collect()} == {"a/b/c": 2, "a/bc": 1, "a": 1}


def test_relations(spark):
    names = [(1, f"n{i}") for i in range(40)] + [(2, f"N{i}") for i in range(40)] + [(3, f"n{i}") for i in range(20)] + [(4, f"x{i}") for i in range(9)] + [(5, f"n{i}") for i in range(30, 60)]
    df = spark.createDataFrame(names, "library_id long, name string")
    libs = spark.createDataFrame([(1, 100, "1.0", False), (2, 101, "1.1", False), (3, 50, "2.0", False), (4, 1, "", False), (5, 70, "9", True)], "id long, size_bytes long, version string, registered boolean")
    pairs = dedup.library_similarity(df)
    got = {(r.a, r.b): (r.relation, r.keep) for r in dedup.classify_relations(pairs, libs).collect()}
    assert got == {(1, 2): ("identical", 2), (1, 3): ("superset", 3), (2, 3): ("superset", 3)}
    swapped = df.select((9 - F.col("library_id")).alias("library_id"), "name")
    assert sorted(r.jaccard for r in dedup.library_similarity(swapped).collect()) == sorted(r.jaccard for r in pairs.collect())


def test_tokens_chunks_pages():
    assert text.tokens_of("Key-Switches glass, buses 汉字表 a") == ["key-switches", "key-switch", "key-switche", "key", "switches", "switch", "switche", "glass", "buses", "bus", "buse", "汉字", "字表"]
    long = "First sentence here. " * 200
    chunks = text.chunks_of(long)
    assert all(0 < len(c) <= text.CHUNK for c in chunks) and chunks[0].endswith(".") and len(chunks) > 4
    assert text.chunks_of("") == text.chunks_of(None) == [] and text.chunks_of("x" * 2000)[0] == "x" * 900
    assert "".join(text.pages_of("a\n" * 5000)).count("a") == 5000


def test_hybrid_search_prefers_the_answer(spark):
    rows = [(i, f"filler chunk {i} about {'mixing rooms' if i % 2 else 'tuning strings'}") for i in range(40)] + [(100, "the microphone position is set on the mic page")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = text.hybrid(df, "id", "text", "microphone position", 5).orderBy(F.desc("relevance")).collect()
    assert got[0].id == 100 and len(got) <= 5


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 1.0)], "id long, score double")
    b = spark.createDataFrame([(3, 9.0), (4, 8.0)], "id long, score double")
    ab, ba = ({r.id: round(r.fused, 9) for r in text.fuse(x, "id").collect()} for x in ([a, b], [b, a]))
    assert ab == ba and ab[3] == round(1 / 63 + 1 / 61, 9)


def test_batch_text():
    rules_ = rules.parse_batch("# note\r\nforeach lib where Junk AND no-cover, name = Ab c: TAG : a:b; category=x\n\nfor lib where nonstandard: build-kb")
    assert rules_ == [(["Junk", "no-cover", "name = Ab c"], "tag", "a:b"), (["category=x"], "list", ""), (["nonstandard"], "build-kb", "")]
    for wrong in ("", "# only a note", "junk: sweep", ": list", "foreach lib where : list"):
        with pytest.raises(ValueError):
            rules.parse_batch(wrong)



def test_density_agrees_with_neighbour_distances(spark):
    """Against single links within the cell's side among points of five neighbours: the same parts, but for borders."""
    r = random.Random(7)
    pts = [(r.gauss(cx, 0.4), r.gauss(cy, 0.4)) for cx, cy in ((0, 0), (6, 0), (0, 7), (8, 8)) for _ in range(70)] + [(r.uniform(-4, 12), r.uniform(-4, 12)) for _ in range(25)]
    df = spark.createDataFrame([(i, 0, x, y, 0) for i, (x, y) in enumerate(pts)], "clip_id long, library_id int, x double, y double, cluster int")
    got = {x.clip_id: x.cluster for x in vectors.dense_clusters(df, 0.5).collect()}
    agree = total = 0
    for i in range(280):
        for j in range(i):
            if got[i] != "-1" and got[j] != "-1":
                total += 1
                agree += (got[i] == got[j]) == (i // 70 == j // 70)
    assert agree / total > 0.99 and sum(got[i] == "-1" for i in range(280)) < 28


def test_postings_and_frequencies(spark):
    texts = ["b a b c1", "", None, "a-a A zz x", "b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", text.latin_tokens(F.col("text")).alias("tokens"))
    docs = docs.union(spark.createDataFrame([(9, ["b", "a", "b", "q", "b"])], "id long, tokens array<string>"))
    got = {tuple(r) for r in text.postings(docs, "id", "tokens").collect()}
    assert got == {(0, "c1", 1), (3, "zz", 1), (9, "a", 1), (9, "b", 3), (9, "q", 1)}
    assert {tuple(r) for r in text.document_frequencies(docs, "tokens").collect()} == {("c1", 1, 1), ("zz", 1, 1), ("a", 1, 1), ("b", 1, 3), ("q", 1, 1)}


def test_both_ways_of_bm25_agree(spark):
    docs = spark.createDataFrame([(0, "apache licence apache"), (1, "the licence of others"), (2, None), (3, "Apache; apache-2 xapache"), (4, "nothing here")], "id long, text string")
    one = text.bm25_text(docs, "id", "text", ["apache", "licence"], 10).collect()
    two = text.bm25(docs.select("id", F.coalesce(text.latin_tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens")), "id", "tokens", ["licence", "apache"], 10).collect()
    assert [r.id for r in one] == [r.id for r in two] == [0, 3, 1]
    with pytest.raises(ValueError):
        text.diversify(spark.range(text.MMR_MOST + 1).selectExpr("id", "1.0D as fused", "array(1.0D) as vec"), "id", "fused", "vec", 3)


def test_batch_rules(spark):
    libs = spark.createDataFrame([(1, "A", "x", 60 << 20, "", True, 5), (2, "B", "y", 0, "c", True, 9)], "id long, name string, category string, junk_bytes long, cover_file string, has_nicnt boolean, size_bytes long")
    got = {tuple(r) for r in rules.batch_rules(libs, [(["JUNK"], "clean", ""), (["category = X", "no-cover"], "tag", "t"), (["name~a"], "tag", "t")]).collect()}
    assert got == {(1, "clean", "", "JUNK"), (1, "tag", "t", "category = X and no-cover")}
    for nothing in ("sparkling", "category", "junk=3", "name=", "min-size=x", "duplicate", "no-kb", "=", "~"):
        assert rules.batch_rules(libs, [([nothing], "list", ""), (["name~a", nothing], "list", "")]).count() == 0, nothing


def test_suffix_repeats(spark):
    row = spark.range(1).select(rules.suffix_repeats(F.lit("ababab"), 4).alias("a"), rules.suffix_repeats(F.lit("aaaa"), 2).alias("b"), rules.suffix_repeats(F.lit("x"), 5).alias("c")).first()
    assert (row.a, row.b, row.c) == (2, 3, 1)


def test_repeat_reminders_at_three_five_eight(spark, tmp_path):
    from sonaria.plans.registry import queries

    events = [(i, 1, "view" if i % 4 == 3 else "click") for i in range(40)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").selectExpr("event_id", "current_timestamp() ts", "user_id", "event_type", "1.0D value", "'{}' props").write.parquet(f"{tmp_path}/events.parquet")
    assert [r.repeats for r in queries()["repeat_call_count"](spark, str(tmp_path)).orderBy("id").collect()] == [3, 5, 8]


def test_vectors_are_made_in_bounded_parts(spark):
    lists = [[f"w{i % 97}", f"x{i}", "same"] for i in range(text.HELD_ROWS + 500)] + [[]]
    parts = list(text.vector_parts(iter(lists)))
    assert len(parts) == 2 and np.allclose(np.concatenate(parts), text.hashed_vectors(lists))
    texts = ["apache license", "the license", None, "", "other words"]
    found = text.likeness(spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(1), "id", "t", "apache license").collect()
    q = text.hashed_vector(text.tokens_of("apache license"))
    assert {r.id: round(r.similarity, 9) for r in found} == {i: round(float(text.hashed_vector(text.tokens_of(texts[i])) @ q), 9) for i in (0, 1, 4)}
    assert text.likeness(spark.createDataFrame([(1, "a word")], "id long, t string"), "id", "t", "").count() == 0


def embedded(value):
    """One text's vector by its definition, a character at a time."""
    import unicodedata

    v = np.zeros(512)

    def add(token, weight):
        h = 1469598103934665603
        for c in token:
            h = ((h ^ ord(c)) * 1099511628211) % 2**64
        for k in range(3):
            hh = (h + k * 0x9E3779B97F4A7C15) % 2**64
            v[hh % 512] += -weight if hh >> 63 else weight

    def word(w):
        if len(w) < 2:
            return []
        return [w] + ([w[:-1]] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else []) + ([w[:-2]] if len(w) > 4 and w.endswith("es") else [])

    tokens, segments, held, cjk = [], [], "", ""
    for c in (value or "") + "\n":
        ideograph = any(a <= c <= b for a, b in ("一鿿", "㐀䶿", "぀ヿ", "가힯"))
        letter = not ideograph and (unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd")
        if letter:
            held += c if c == "İ" else "σ" if c == "Σ" else c.lower()
        elif held:
            segments, held = [*segments, held], ""
        if not letter and c not in "-_/." and segments:
            tokens += [t for w in (["".join(segments)] if len(segments) > 1 else []) + segments for t in word(w)]
            segments = []
        if ideograph:
            cjk += c
        elif cjk:
            tokens += [cjk[i : i + 2] for i in range(len(cjk) - 1)] or [cjk]
            cjk = ""
    for t in tokens:
        add(t, 1.0)
        for i in range(len(t) - 2):
            add("3:" + t[i : i + 3], 0.35)
    return v / (np.sqrt(v @ v) or 1.0)


def test_whole_texts_of_any_script_are_embedded(spark, tmp_path):
    from sonaria.plans.registry import queries

    texts = ["Key-Switches, glasses: key--switch a/b.c _x_ key_", "", None, " \n\t", "a - b", "Où l'été s'achève; Größe, años", "汉字表", "汉 key漢字-pad 한국어", "Μέγας ΛΌΓΟΣ İstanbul", "привет мир", "the the cat 123 3:the"]
    texts += ["word " * 30_000 + "end", "x" * 20_000, "字" * 3000, *(f"n{i} clip-{i % 7} été" for i in range(text.HELD_ROWS))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries()["hash_embed_512"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, t in enumerate(texts):
        want = embedded(t)
        assert np.allclose(got[i].embedding, want, atol=1e-6), t and t[:60]
        assert got[i].norm == (1.0 if want.any() else 0.0)


def test_a_vector_does_not_depend_on_its_neighbours():
    texts = [f"les étés n{i} d'une clé-{i % 5} 汉字" * (i % 9) for i in range(300)]
    alone = np.concatenate([text.hashed_vectors([text.embed_runs(t)], text.embed_tokens) for t in texts])
    assert (np.concatenate(list(text.vector_parts(map(text.embed_runs, texts), text.embed_tokens))) == alone).all()
    assert text.hashed_vector(["𝒂b𝒄"]).any() and len(text.hashed_vectors([["a"], []], text.embed_tokens)) == 2


def test_parts_are_bounded_by_characters():
    long = [["x" * (text.HELD_CHARS // 2)]] * 5
    assert [len(v) for v in text.vector_parts(iter(long))] == [2, 2, 1]
