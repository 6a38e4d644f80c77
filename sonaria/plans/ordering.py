"""Sorts, limits, windows, ranks and set operations of the catalog."""

from pyspark.sql import functions as F

from sonaria.operators.relational import first_rows, global_ranks, newest
from sonaria.plans.registry import query
from sonaria.streaming.repeats import repeat_notices


@query("multi_key_sort", "libraries", "SELECT id, name, category FROM libraries ORDER BY category DESC, lower(name), id LIMIT 40")
def multi_key_sort(c):
    return c("libraries").orderBy(F.desc("category"), F.lower("name"), "id").limit(40).select("id", "name", "category")


@query("top_libraries", "libraries", "SELECT id, name, size_bytes FROM libraries ORDER BY size_bytes DESC, id LIMIT 16")
def top_libraries(c):
    return c("libraries").orderBy(F.desc("size_bytes"), "id").limit(16).select("id", "name", "size_bytes")


@query("offset_page", "instruments", "SELECT id, name FROM instruments ORDER BY lower(name), id LIMIT 50 OFFSET 100")
def offset_page(c):
    return c("instruments").orderBy(F.lower("name"), "id").offset(100).limit(50).select("id", "name")


@query("demo_first_sample", "clips", "SELECT id, kind FROM clips WHERE library_id = 7 ORDER BY CASE WHEN kind = 'demo' THEN 0 ELSE 1 END, id LIMIT 24")
def demo_first_sample(c):
    return c("clips").where("library_id = 7").orderBy(F.when(F.col("kind") == "demo", 0).otherwise(1), "id").limit(24).select("id", "kind")


@query("seeded_sample")
def seeded_sample(c, seed: int = 7, limit: int = 24):
    """A sample in an order that the seed decides, demos first; the feature itself is a limit."""
    return c("clips").where("library_id = 7").orderBy(F.when(F.col("kind") == "demo", 0).otherwise(1), F.xxhash64("id", F.lit(seed)), "id").limit(limit).select("id", "kind")


@query("first_instrument", "instruments", "SELECT library_id, min_by(id, rel_path || lpad(CAST(id AS VARCHAR), 12, '0')) AS id FROM instruments WHERE kind = 'nki' GROUP BY 1")
def first_instrument(c):
    first = F.min(F.struct("rel_path", "id"))["id"]
    return c("instruments").where("kind = 'nki'").groupBy("library_id").agg(first.alias("id"))


@query("distinct_case_insensitive", "libraries", "SELECT min(trim(category)) AS tag FROM libraries WHERE trim(category) <> '' AND length(trim(category)) <= 32 GROUP BY lower(trim(category)) ORDER BY tag LIMIT 20")
def distinct_case_insensitive(c):
    tags = c("libraries").select(F.trim("category").alias("t")).where("t <> '' and length(t) <= 32")
    return tags.groupBy(F.lower("t").alias("k")).agg(F.min("t").alias("tag")).orderBy("tag").limit(20).select("tag")


@query("dedupe_ops", "instruments", "SELECT library_id, kind, min(id) AS id FROM instruments GROUP BY 1, 2")
def dedupe_ops(c):
    """The first operation of each library, action and argument."""
    return c("instruments").groupBy("library_id", "kind").agg(F.min("id").alias("id"))


@query("file_set_diff", "instruments", """WITH a AS (SELECT DISTINCT lower(name || size_bytes) AS f, size_bytes FROM instruments WHERE library_id = 3), b AS (SELECT DISTINCT lower(name || size_bytes) AS f, size_bytes FROM instruments WHERE library_id = 5)
    SELECT 'a' AS side, f, size_bytes FROM a WHERE f NOT IN (SELECT f FROM b) UNION ALL SELECT 'b', f, size_bytes FROM b WHERE f NOT IN (SELECT f FROM a)""")
def file_set_diff(c, a: int = 3, b: int = 5):
    """Files of one library that the other lacks, whatever their case."""
    name = F.lower(F.concat(F.col("name"), F.col("size_bytes").cast("string"))).alias("f")
    left, right = (c("instruments").where(F.col("library_id") == x).select(name, "size_bytes").distinct() for x in (a, b))
    only = lambda p, q, side: p.join(q.select("f"), "f", "left_anti").select(F.lit(side).alias("side"), "f", "size_bytes")
    return only(left, right, "a").unionByName(only(right, left, "b"))


@query("union_all_sources", "manuals junk", "SELECT 'manual' AS source, count(*) AS n FROM manuals UNION ALL SELECT 'junk', count(*) FROM junk")
def union_all_sources(c):
    one = lambda name, label: c(name).agg(F.count("*").alias("n")).select(F.lit(label).alias("source"), "n")
    return one("manuals", "manual").unionByName(one("junk", "junk"))


@query("set_intersection_cluster", "points", "SELECT clip_id FROM points WHERE cluster = 2 INTERSECT SELECT clip_id FROM points WHERE x > 0")
def set_intersection_cluster(c):
    return c("points").where("cluster = 2").select("clip_id").intersect(c("points").where("x > 0").select("clip_id"))


@query("uniform_pick", "points", "WITH r AS (SELECT clip_id, row_number() OVER (ORDER BY clip_id) - 1 AS i, count(*) OVER () AS n FROM points WHERE cluster = 1), k AS (SELECT DISTINCT (j * (SELECT max(n) FROM r)) // 10 AS i FROM range(10) t(j)) SELECT clip_id FROM r WHERE i IN (SELECT i FROM k)")
def uniform_pick(c, k: int = 10):
    """``k`` items at even steps of the order of ids, by their rank."""
    rows = global_ranks(c("points").where("cluster = 1").select(F.col("clip_id").cast("double").alias("v"), "clip_id"), "v")
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.floor(j * F.col("n") / k))
    return rows.where(F.array_contains(picks, F.col("less"))).select("clip_id")


@query("overview_sample", "manuals", "WITH r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM manuals WHERE ext = 'pdf') SELECT id FROM r WHERE i < 2 OR (i >= 2 AND (i - 2) % greatest((n - 2) // 6, 1) = 0 AND (i - 2) // greatest((n - 2) // 6, 1) < 6)")
def overview_sample(c, k: int = 8):
    """The first two and then even steps to ``k``."""
    rows = global_ranks(c("manuals").where("ext = 'pdf'").select(F.col("id").cast("double").alias("v"), "id"), "v")
    step = F.greatest(F.floor((F.col("n") - 2) / (k - 2)), F.lit(1))
    i = F.col("less")
    return rows.where((i < 2) | ((i >= 2) & ((i - 2) % step == 0) & (F.floor((i - 2) / step) < k - 2))).select("id")


@query("tag_merge", "tag_map", "SELECT DISTINCT entity_type, entity_id, CASE WHEN tag_id = 3 THEN 5 ELSE tag_id END AS tag_id FROM tag_map")
def tag_merge(c, old: int = 3, new: int = 5):
    """All uses of a tag become uses of another, once each."""
    return c("tag_map").withColumn("tag_id", F.when(F.col("tag_id") == old, new).otherwise(F.col("tag_id"))).distinct()


@query("tag_set_overwrite", "tag_map", "SELECT entity_id, tag_id FROM tag_map WHERE entity_id <> 4 UNION ALL SELECT CAST(4 AS BIGINT), CAST(t AS INT) FROM (VALUES (1), (8)) v(t)")
def tag_set_overwrite(c):
    rest = c("tag_map").where("entity_id <> 4").select("entity_id", "tag_id")
    return rest.unionByName(c.spark.createDataFrame([(4, 1), (4, 8)], "entity_id long, tag_id int"))


@query("tag_delete", "tags tag_map", "SELECT entity_id, tag_id FROM tag_map WHERE tag_id NOT IN (SELECT id FROM tags WHERE name = 'NATION_2')")
def tag_delete(c):
    gone = c("tags").where("name = 'NATION_2'").select(F.col("id").alias("tag_id"))
    return c("tag_map").join(gone, "tag_id", "left_anti").select("entity_id", "tag_id")


@query("toggle_favorite", "favorites", "SELECT instrument_id FROM favorites WHERE instrument_id NOT IN (7, 44) UNION ALL SELECT CAST(i AS BIGINT) FROM (VALUES (7), (44)) v(i) WHERE i NOT IN (SELECT instrument_id FROM favorites)")
def toggle_favorite(c):
    """Those toggled leave if they are in, and come in if they are not."""
    now, flip = c("favorites"), c.spark.createDataFrame([(7,), (44,)], "instrument_id long")
    return now.join(flip, "instrument_id", "left_anti").unionByName(flip.join(now, "instrument_id", "left_anti"))


@query("percentile_rank", "", "SELECT vec_id, round(percent_rank() OVER (ORDER BY embedding[27]), 6) AS p FROM embeddings")
def percentile_rank(c):
    """Smaller values over all others; 0.5 for a single row. No window holds all rows."""
    rows = global_ranks(c.table("embeddings").select("vec_id", F.get("embedding", F.lit(26)).cast("double").alias("v")), "v")
    return rows.select("vec_id", F.round(F.when(F.col("n") > 1, F.col("less") / (F.col("n") - 1)).otherwise(0.5), 6).alias("p"))


@query("per_library_cap", "clips", "WITH r AS (SELECT id, library_id, row_number() OVER (PARTITION BY library_id ORDER BY id) AS rn FROM clips) SELECT id, library_id FROM r WHERE rn <= 40")
def per_library_cap(c, cap: int = 40):
    return first_rows(c("clips").select("id", "library_id"), ["library_id"], "id", cap).select("id", "library_id")


@query("latest_n_chronological", "messages", "SELECT session_id, id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS rn FROM messages) WHERE rn <= 3")
def latest_n_chronological(c, n: int = 3):
    """The last messages of each session; of each shard of a session first."""
    rows = c("messages").select("session_id", "id", (-F.col("id")).alias("back"))
    return first_rows(rows, ["session_id"], "back", n).select("session_id", "id")


@query("repeat_call_count", "trace", """WITH s AS (SELECT session_id, id, tool_name || '|' || args AS fp, row_number() OVER (PARTITION BY session_id ORDER BY id) AS seq FROM trace WHERE tool_name <> 'view'),
    r AS (SELECT a.session_id, a.id, CAST(count(*) AS INT) AS repeats FROM s a JOIN s b ON a.session_id = b.session_id AND a.fp = b.fp AND b.seq BETWEEN a.seq - 23 AND a.seq GROUP BY 1, 2) SELECT session_id, id, repeats FROM r WHERE repeats IN (3, 5, 8)""")
def repeat_call_count(c, last: int = 24):
    """Calls that are the third, fifth or eighth with the same arguments among a session's last 24; some tools do not count."""
    return repeat_notices(c("trace"), ["view"], last)


@query("repeat_call_few", "trace", """WITH s AS (SELECT session_id % 9 AS session_id, id, tool_name, id % 6 AS k, row_number() OVER (PARTITION BY session_id % 9 ORDER BY id) AS seq FROM trace WHERE tool_name <> 'view'),
    r AS (SELECT a.session_id, a.id, CAST(count(*) AS INT) AS repeats FROM s a JOIN s b ON a.session_id = b.session_id AND a.tool_name = b.tool_name AND a.k = b.k AND b.seq BETWEEN a.seq - 23 AND a.seq GROUP BY 1, 2) SELECT session_id, id, repeats FROM r WHERE repeats IN (3, 5, 8)""")
def repeat_call_few(c):
    """The same of few long sessions with few arguments, with and without white space."""
    k = (F.col("id") % 6).cast("string")
    args = F.when(F.col("id") % 4 < 2, F.concat(F.lit('{"k": '), k, F.lit("}"))).otherwise(F.concat(F.lit('{"k":'), k, F.lit(" }")))
    return repeat_notices(c("trace").withColumn("args", args).withColumn("session_id", F.col("session_id") % 9), ["view"])


@query("kb_page_view", "manuals", "SELECT id FROM manuals ORDER BY id LIMIT 60 OFFSET 120")
def kb_page_view(c, page: int = 3, size: int = 60):
    size, page = max(1, min(200, size)), max(1, page)
    return c("manuals").select("id").orderBy("id").offset((page - 1) * size).limit(size)
