"""Aggregates and reports of the catalog."""

from pyspark.sql import functions as F

from sonaria.functions import scalars as S
from sonaria.operators.bases import catalog
from sonaria.operators.nested import counts_with_names, manuals_tree, manuals_tree_totals, sessions_tree
from sonaria.operators.relational import zero_filled
from sonaria.plans.documents import BASES, knowledge_bases
from sonaria.plans.registry import query

GIB = 1 << 30


@query("dashboard_totals", "libraries", "SELECT count(*) AS libraries, CAST(sum(size_bytes) AS BIGINT) AS bytes, CAST(sum(file_count) AS BIGINT) AS files, CAST(sum(nki_count) AS BIGINT) AS instruments, CAST(sum(junk_count) AS BIGINT) AS junk, CAST(count(*) FILTER (NOT has_nicnt) AS BIGINT) AS unlabelled FROM libraries")
def dashboard_totals(c):
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return c("libraries").agg(F.count("*").alias("libraries"), total("size_bytes").alias("bytes"), total("file_count").alias("files"), total("nki_count").alias("instruments"), total("junk_count").alias("junk"), F.count_if(~F.col("has_nicnt")).alias("unlabelled"))


@query("dashboard_instruments", "instruments", "SELECT count(*) AS total, count(*) FILTER (name_source = 'header') AS from_header, count(*) FILTER (size_bytes < 10240) AS legacy FROM instruments")
def dashboard_instruments(c):
    return c("instruments").agg(F.count("*").alias("total"), F.count_if(F.col("name_source") == "header").alias("from_header"), F.count_if(F.col("size_bytes") < 10240).alias("legacy"))


_CATEGORIES = [f"NATION_{i}" for i in range(0, 20)] + ["Empty"]


@query("category_stats", "libraries", f"""WITH d AS (SELECT unnest({_CATEGORIES}) AS category), a AS (SELECT category, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM libraries GROUP BY 1)
    SELECT coalesce(a.category, d.category) AS category, coalesce(n, 0) AS n, coalesce(bytes, 0) AS bytes FROM d FULL JOIN a ON d.category = a.category""")
def category_stats(c):
    """All display categories, with zeros for those without libraries; unknown ones stay."""
    return zero_filled(c("libraries"), "category", _CATEGORIES, {"n": F.count("*"), "bytes": F.sum("size_bytes")}).orderBy(F.desc("bytes"), "category")


@query("roots_summary", "roots libraries", "SELECT r.id, r.path, count(l.id) AS libraries, CAST(coalesce(sum(l.size_bytes), 0) AS BIGINT) AS bytes FROM roots r LEFT JOIN libraries l ON l.root_id = r.id GROUP BY 1, 2")
def roots_summary(c):
    sums = c("libraries").groupBy(F.col("root_id").alias("id")).agg(F.count("*").alias("libraries"), F.sum("size_bytes").alias("bytes"))
    return c("roots").join(sums, "id", "left").select("id", "path", F.coalesce("libraries", F.lit(0)).alias("libraries"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


@query("clip_kind_counts", "clips", "SELECT count(*) FILTER (kind = 'demo') AS demo, count(*) FILTER (kind = 'sample') AS sample, count(*) FILTER (kind = 'ncw') AS ncw, count(*) FILTER (ext = 'nkx') AS nkx FROM clips WHERE library_id = 5")
def clip_kind_counts(c, library: int = 5):
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("demo", "sample", "ncw")]
    return c("clips").where(F.col("library_id") == library).agg(*kinds, F.count_if(F.col("ext") == "nkx").alias("nkx"))


@query("library_stats", "libraries", "SELECT coalesce(nullif(category, ''), 'uncategorised') AS category, count(*) AS libraries, round(CAST(CAST(sum(size_bytes) AS BIGINT) / 107374182.4 AS DOUBLE)) / 10 AS gib FROM libraries GROUP BY 1")
def library_stats(c):
    name = F.coalesce(F.nullif("category", F.lit("")), F.lit("uncategorised"))
    return c("libraries").groupBy(name.alias("category")).agg(F.count("*").alias("libraries"), (F.round(F.sum("size_bytes") / 107374182.4) / 10).alias("gib"))


@query("library_stats_top", "libraries", "SELECT id, name, size_bytes FROM libraries ORDER BY size_bytes DESC, id LIMIT 10")
def library_stats_top(c):
    return c("libraries").orderBy(F.desc("size_bytes"), "id").limit(10).select("id", "name", "size_bytes")


@query("category_rollup_names", "libraries", "SELECT category, count(*) AS n, round(CAST(CAST(sum(size_bytes) AS BIGINT) / 107374182.4 AS DOUBLE)) / 10 AS gib, array_to_string(list_slice(list(name ORDER BY name), 1, 8), ',') AS names FROM libraries GROUP BY 1")
def category_rollup_names(c, names: int = 8):
    made = counts_with_names(c("libraries").select("category", "id", "name", "size_bytes"), "category", names, {"gib": F.round(F.sum("size_bytes") / 107374182.4) / 10})
    return made.withColumn("names", F.array_join("names", ","))


@query("articulation_breakdown", "instruments", "WITH p AS (SELECT * FROM instruments ORDER BY id LIMIT 300) SELECT name_source AS articulation, count(*) AS n FROM p GROUP BY 1")
def articulation_breakdown(c):
    """Counts over the page that is shown, not over all hits."""
    return c("instruments").orderBy("id").limit(300).groupBy(F.col("name_source").alias("articulation")).agg(F.count("*").alias("n"))


@query("instrument_groups", "instruments", """WITH g AS (SELECT concat(split_part(rel_path, '/', 1), '\\', split_part(rel_path, '/', 2)) AS dir, count(*) AS n FROM instruments GROUP BY 1)
    SELECT concat(dir, ' (', CAST(n AS VARCHAR), ')') AS label FROM g ORDER BY n DESC, dir LIMIT 30""")
def instrument_groups(c):
    made = c("instruments").groupBy(S.group_dir(F.col("rel_path")).alias("dir")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dir").limit(30)
    return made.select(F.format_string("%s (%d)", "dir", "n").alias("label"))


@query("trace_stats", "trace", "SELECT tool_name, count(*) AS calls, count(*) FILTER (NOT ok) AS fails, round_even(avg(elapsed_ms), 3) AS avg_ms, round_even(avg(result_chars), 3) AS avg_chars FROM trace GROUP BY 1")
def trace_stats(c):
    return c("trace").groupBy("tool_name").agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("fails"), F.bround(F.avg("elapsed_ms"), 3).alias("avg_ms"), F.bround(F.avg("result_chars"), 3).alias("avg_chars")).orderBy(F.desc("calls"), "tool_name")


@query("trace_timeline", "trace", "SELECT session_id, min(created_at) AS first_at, max(created_at) AS last_at FROM trace GROUP BY 1")
def trace_timeline(c):
    return c("trace").groupBy("session_id").agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


@query("tool_token_totals", "trace", "SELECT tool_name, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, count(*) AS calls, count(*) FILTER (NOT ok) AS fails FROM trace GROUP BY 1")
def tool_token_totals(c):
    return c("trace").groupBy("tool_name").agg(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("fails"))


@query("junk_by_library", "junk", "SELECT library_id, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM junk WHERE NOT suggested_keep GROUP BY 1 HAVING sum(size_bytes) > 20000000")
def junk_by_library(c):
    return c("junk").where("not suggested_keep").groupBy("library_id").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes")).where("bytes > 20000000")


@query("junk_list_report", "junk", "SELECT kind, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM junk GROUP BY 1")
def junk_list_report(c):
    return c("junk").groupBy("kind").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


_TREE = """WITH b AS (SELECT library_id, min(id) AS source, library_id % 7 AS pages FROM manuals WHERE library_id % 4 = 0 GROUP BY 1 HAVING library_id % 7 > 0),
    m AS (SELECT m.*, b.source IS NOT NULL AS built, CASE WHEN b.source = m.id THEN b.pages ELSE 0 END AS pages, row_number() OVER (PARTITION BY m.library_id ORDER BY is_primary DESC, m.name, m.id) - 1 AS rn, count(*) OVER (PARTITION BY m.library_id) AS n FROM manuals m LEFT JOIN b ON b.library_id = m.library_id)"""


def _tree_bases(c):
    """Every fourth library has a base, of its first manual; that of every seventh has no page."""
    rows = c("manuals").where("library_id % 4 = 0").groupBy("library_id").agg(F.min("id").alias("manual_id"))
    return rows.withColumn("pages", F.col("library_id") % 7)


@query("manuals_nested", "libraries manuals", _TREE + """ SELECT coalesce(l.category, 'uncategorised') AS category, m.library_id, coalesce(l.name, '') AS library_name, n AS manuals, built, rn // 25 AS block, string_agg(concat(m.name, ':', pages), '|' ORDER BY rn) AS items
    FROM m LEFT JOIN libraries l ON l.id = m.library_id GROUP BY ALL""")
def manuals_nested(c):
    """Manuals nested in libraries, libraries in categories."""
    rows = manuals_tree(c("manuals"), c("libraries"), _tree_bases(c), 25)
    return rows.withColumn("items", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["name"], x["pages"].cast("string"))), "|"))


@query("manuals_nested_totals", "manuals", _TREE + " SELECT count(*) AS manuals, count(*) FILTER (built) AS built, count(DISTINCT library_id) AS libraries FROM m")
def manuals_nested_totals(c):
    return manuals_tree_totals(c("manuals"), _tree_bases(c))


@query("chat_sessions_grouped", "messages", """WITH s AS (SELECT CASE category_id WHEN 0 THEN 'uncategorised' ELSE concat('c', category_id) END AS category, session_id, count(*) AS n, session_id * 37 % 1000 * 100 + count(*) AS updated FROM messages GROUP BY 1, 2),
    p AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY updated DESC, session_id) - 1 AS rn, count(*) OVER (PARTITION BY category) AS sessions, max(updated) OVER (PARTITION BY category) AS newest FROM s)
    SELECT category, sessions, newest, rn // 20 AS block, string_agg(concat(session_id, ':', n), '|' ORDER BY rn) AS items FROM p GROUP BY ALL""")
def chat_sessions_grouped(c):
    """Sessions nested in categories, those changed last first."""
    name = F.when(F.col("category_id") == 0, "").otherwise(F.concat(F.lit("c"), F.col("category_id").cast("string")))
    per = c("messages").groupBy(name.alias("category"), "session_id").agg(F.count("*").alias("messages"))
    rows = sessions_tree(per.withColumn("updated_at", F.col("session_id") * 37 % 1000 * 100 + F.col("messages")), 20)
    return rows.withColumn("items", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["session_id"].cast("string"), x["messages"].cast("string"))), "|"))


@query("session_stats", "messages trace", "SELECT m.session_id, count(*) FILTER (role = 'user') AS turns, coalesce((SELECT count(*) FROM trace t WHERE t.session_id = m.session_id), 0) AS steps FROM messages m GROUP BY m.session_id")
def session_stats(c):
    turns = c("messages").groupBy("session_id").agg(F.count_if(F.col("role") == "user").alias("turns"))
    steps = c("trace").groupBy("session_id").agg(F.count("*").alias("steps"))
    return turns.join(steps, "session_id", "left").select("session_id", "turns", F.coalesce("steps", F.lit(0)).alias("steps"))


@query("compat_report", "libraries", """SELECT CASE WHEN required_version = '' THEN 'unknown' WHEN (CAST(split_part(required_version, '.', 1) AS INT), CAST(split_part(required_version, '.', 2) AS INT), CAST(split_part(required_version, '.', 3) AS INT)) > (6, 4, 0) THEN 'too-old' ELSE 'ok' END AS status, count(*) AS n FROM libraries GROUP BY 1""")
def compat_report(c, installed: str = "6.4.0"):
    status = F.when(~S.version_valid(F.col("required_version")), "unknown").when(S.version_key(F.col("required_version")) > S.version_key(F.lit(installed)), "too-old").otherwise("ok")
    return c("libraries").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("parent_folder_rollup", "libraries", "SELECT split_part(path, '/', 1) AS parent, count(*) AS n FROM libraries GROUP BY 1 ORDER BY n DESC, parent LIMIT 12")
def parent_folder_rollup(c):
    return c("libraries").groupBy(S.parent_dir(F.col("path")).alias("parent")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "parent").limit(12)


@query("coverage_stats", "clips", "SELECT count(*) AS total, count(*) FILTER (ext <> 'nkx') AS decodable, count(*) FILTER (ext <> 'nkx' AND id % 3 = 0) AS extracted, round_even(100.0 * count(*) FILTER (ext <> 'nkx' AND id % 3 = 0) / count(*) FILTER (ext <> 'nkx'), 1) AS percent FROM clips")
def coverage_stats(c):
    done = c("clips").where("id % 3 = 0").select("id").distinct().withColumn("done", F.lit(True))
    can = S.is_decodable(F.col("ext"))
    rows = c("clips").select("id", can.alias("can")).join(done, "id", "left")
    n, k = F.count_if("can"), F.count_if(F.col("can") & F.col("done"))
    return rows.agg(F.count("*").alias("total"), n.alias("decodable"), k.alias("extracted"), F.bround(100.0 * k / n, 1).alias("percent"))


@query("cluster_meta", "points", """WITH a AS (SELECT cluster, count(*) AS n, avg(x) AS cx, avg(y) AS cy, count(DISTINCT library_id) AS libraries FROM points WHERE cluster >= 0 GROUP BY 1),
    m AS (SELECT cluster, library_id, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, library_id) AS rn FROM points GROUP BY 1, 2),
    r AS (SELECT p.cluster, p.clip_id, row_number() OVER (PARTITION BY p.cluster ORDER BY round((x - cx) * (x - cx) + (y - cy) * (y - cy), 12), clip_id) AS rn FROM points p JOIN a ON a.cluster = p.cluster)
    SELECT a.cluster, a.n, round(100.0 * a.n / (SELECT count(*) FROM points), 2) AS share, round(cx, 6) AS cx, round(cy, 6) AS cy, libraries, m.library_id AS main_library, r.clip_id AS representative
    FROM a JOIN m ON m.cluster = a.cluster AND m.rn = 1 JOIN r ON r.cluster = a.cluster AND r.rn = 1""")
def cluster_meta(c):
    from sonaria.operators.vectors import cluster_meta as meta

    return meta(c("points"))


@query("symbol_categories", "instruments", """WITH s AS (SELECT DISTINCT concat(CASE size_bytes // 1024 % 4 WHEN 0 THEN 'set_' WHEN 1 THEN 'get_' WHEN 2 THEN 'note_' ELSE '' END, split_part(name, ' ', 1)) AS name, CASE WHEN size_bytes // 1024 % 6 = 0 THEN 'callback' ELSE 'command' END AS kind FROM instruments)
    SELECT CASE WHEN kind <> 'command' THEN kind WHEN name LIKE 'set\\_%' ESCAPE '\\' THEN 'setter' WHEN name LIKE 'get\\_%' ESCAPE '\\' THEN 'getter' WHEN regexp_matches(lower(name), 'array|list') THEN 'arrays' WHEN regexp_matches(lower(name), 'midi|note|event') THEN 'events' ELSE 'general' END AS category, count(*) AS n FROM s GROUP BY 1""")
def symbol_categories(c):
    """Symbols of each category, the most first."""
    size = F.floor(F.col("size_bytes") / 1024)
    start = F.when(size % 4 == 0, "set_").when(size % 4 == 1, "get_").when(size % 4 == 2, "note_").otherwise("")
    symbols = c("instruments").select(F.concat(start, F.split_part("name", F.lit(" "), F.lit(1))).alias("name"), F.when(size % 6 == 0, "callback").otherwise("command").alias("kind")).distinct()
    return symbols.groupBy(S.symbol_category(F.col("name"), F.col("kind")).alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


@query("batch_by_action", "libraries", "WITH o AS (SELECT CASE WHEN junk_bytes > 52428800 THEN 'clean' WHEN cover_file = '' THEN 'cover' ELSE 'tag' END AS action, name FROM libraries) SELECT action, count(*) AS n, array_to_string(list_slice(list(name ORDER BY name), 1, 10), ',') AS samples FROM o GROUP BY 1")
def batch_by_action(c):
    action = F.when(F.col("junk_bytes") > 52428800, "clean").when(F.col("cover_file") == "", "cover").otherwise("tag")
    made = counts_with_names(c("libraries").select(action.alias("action"), "id", "name"), "action", 10)
    return made.select("action", "n", F.array_join("names", ",").alias("samples"))


@query("map_stats", "points clips", "SELECT (SELECT count(*) FROM points) AS points, (SELECT count(DISTINCT cluster) FROM points WHERE cluster >= 0) AS clusters, round(100.0 * (SELECT count(*) FROM points) / (SELECT count(*) FROM clips), 3) AS coverage")
def map_stats(c):
    p = c("points").agg(F.count("*").alias("points"), F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"))
    n = c("clips").agg(F.count("*").alias("__n"))
    return p.crossJoin(n).select("points", "clusters", F.round(100.0 * F.col("points") / F.col("__n"), 3).alias("coverage"))  # one row each


@query("kb_catalog", "manuals", f"""WITH {BASES}, p AS (SELECT doc_id, count(*) AS page_count, CAST(sum(length(line)) AS BIGINT) AS total_chars, CAST(sum((length(line) - 1) // 900 + 1) AS BIGINT) AS chunk_count, arg_min(line, page) AS first FROM lines GROUP BY 1)
    SELECT doc_id AS library_id, name AS library_name, ext AS category, concat('m', doc_id % 11) AS manual_name, page_count, total_chars, chunk_count, doc_id * 7919 % 100003 AS built_at, CASE WHEN length(first) > 240 THEN concat(first[1:240], '…') ELSE first END AS overview FROM p JOIN manuals m ON m.id = p.doc_id""")
def kb_catalog(c):
    """Every document is a base; its library is the manual of the same number."""
    return catalog(knowledge_bases(c), c("manuals").select("id", "name", F.col("ext").alias("category")))


@query("export_libraries", "libraries manuals junk", """SELECT l.name, l.category, l.size_bytes, coalesce((SELECT count(*) FROM manuals m WHERE m.library_id = l.id), 0) AS manuals, coalesce((SELECT count(*) FROM junk j WHERE j.library_id = l.id), 0) AS junk FROM libraries l""")
def export_libraries(c):
    """The rows of the CSV and Markdown exports, larger libraries first."""
    count = lambda name: c(name).groupBy(F.col("library_id").alias("id")).agg(F.count("*").alias(name))
    rows = c("libraries").join(count("manuals"), "id", "left").join(count("junk"), "id", "left")
    return rows.select("name", "category", "size_bytes", F.coalesce("manuals", F.lit(0)).alias("manuals"), F.coalesce("junk", F.lit(0)).alias("junk")).orderBy(F.desc("size_bytes"), "name")
