"""Rule queries: batches, health, suggestions, registration, claims and other reports."""

from pyspark.sql import functions as F

from sonaria.operators import rules as R
from sonaria.operators import moves as M
from sonaria.plans.registry import query

_RULES = [(["junk"], "clean", ""), (["no-cover", "category=NATION_3"], "tag", "cover"), (["name~0007"], "tag", "cover"), (["nonstandard", "min-size=50000000000"], "register", ""), (["duplicate", "no-kb"], "build-kb", ""), (["unregistered"], "register", ""), (["duplicate"], "list", ""), (["sparkling"], "list", ""), (["junk=3"], "list", "")]
_NAMES = "SELECT c_nationkey AS library_id, concat(c_mktsegment, CAST(CAST(floor(c_acctbal / 2000) AS BIGINT) AS STRING)) AS name FROM customer"


def _related(c):
    """The libraries with their keys, those that meet conditions on other tables, and the names."""
    libraries = c("libraries").withColumn("product_key", F.concat(F.lit("K"), F.col("id").cast("string")))
    names = c.table("customer").select(F.col("c_nationkey").alias("library_id"), F.concat("c_mktsegment", F.floor(F.col("c_acctbal") / 2000).cast("string")).alias("name"))
    manuals = c("manuals").withColumn("mtime", F.lit(5))
    bases = manuals.select("library_id", F.col("name").alias("manual_name"), F.when(F.col("library_id") % 4 == 0, 5).otherwise(4).alias("built")).distinct()
    return libraries, R.related_ids(libraries, names, c("registered"), manuals, bases), names


@query("batch_dsl_expand", "libraries registered manuals", f"""WITH n AS (SELECT DISTINCT library_id, lower(name) AS name FROM ({_NAMES})), k AS (SELECT library_id, count(*) AS k FROM n GROUP BY 1), s AS (SELECT a.library_id AS a, b.library_id AS b, count(*) AS s FROM n a JOIN n b ON a.name = b.name AND a.library_id <> b.library_id GROUP BY 1, 2),
    dup AS (SELECT DISTINCT a AS id FROM s JOIN k ka ON ka.library_id = a JOIN k kb ON kb.library_id = b WHERE s >= 0.55 * (ka.k + kb.k - s) - 1e-9),
    nokb AS (SELECT library_id AS id FROM manuals GROUP BY 1 HAVING library_id % 4 <> 0),
    o AS (SELECT id, 0 AS r, 'clean' AS action, '' AS arg, 'junk' AS reason FROM libraries WHERE junk_bytes > 52428800 UNION ALL SELECT id, 1, 'tag', 'cover', 'no-cover and category=NATION_3' FROM libraries WHERE has_nicnt AND cover_file = '' AND lower(category) = 'nation_3'
    UNION ALL SELECT id, 2, 'tag', 'cover', 'name~0007' FROM libraries WHERE contains(lower(name), '0007') UNION ALL SELECT id, 3, 'register', '', 'nonstandard and min-size=50000000000' FROM libraries WHERE NOT has_nicnt AND size_bytes >= 50000000000
    UNION ALL SELECT id, 4, 'build-kb', '', 'duplicate and no-kb' FROM libraries WHERE id IN (SELECT id FROM dup) AND id IN (SELECT id FROM nokb)
    UNION ALL SELECT id, 5, 'register', '', 'unregistered' FROM libraries WHERE has_nicnt AND concat('k', CAST(id AS STRING)) NOT IN (SELECT lower(reg_key) FROM registered) UNION ALL SELECT id, 6, 'list', '', 'duplicate' FROM libraries WHERE id IN (SELECT id FROM dup))
    SELECT id, action, arg, min_by(reason, r) AS reason FROM o GROUP BY 1, 2, 3""")
def batch_expand(c):
    """Rules on libraries and on other tables; those with an unknown condition fit nothing. The knowledge base of
    every fourth library is as new as its manual."""
    libraries, related, _ = _related(c)
    return R.batch_rules(libraries, _RULES, related)


_CLAUSES = """# clean up first
foreach lib where junk: tag:clean; no-cover and category=NATION_3 : tag:cover
name=0007, nonstandard
FOREACH LIBRARY WHERE nonstandard AND min-size=50000000000: register"""


@query("batch_dsl_parse", "libraries", """WITH o AS (SELECT id, 0 AS r, 'tag' AS action, 'clean' AS arg, 'junk' AS reason FROM libraries WHERE junk_bytes > 52428800 UNION ALL SELECT id, 1, 'tag', 'cover', 'no-cover and category=NATION_3' FROM libraries WHERE has_nicnt AND cover_file = '' AND category = 'NATION_3'
    UNION ALL SELECT id, 2, 'list', '', 'name=0007 and nonstandard' FROM libraries WHERE contains(lower(name), '0007') AND NOT has_nicnt UNION ALL SELECT id, 3, 'register', '', 'nonstandard and min-size=50000000000' FROM libraries WHERE NOT has_nicnt AND size_bytes >= 50000000000)
    SELECT id, action, arg, min_by(reason, r) AS reason FROM o GROUP BY 1, 2, 3""")
def batch_parse(c):
    """Rules in their text form, applied to all libraries."""
    return R.batch_rules(c("libraries"), R.parse_batch(_CLAUSES))


@query("health_issues", "libraries junk manuals", """SELECT library_id AS id, 'junk' AS issue, CAST(sum(size_bytes) AS BIGINT) AS detail FROM junk GROUP BY 1 HAVING sum(size_bytes) > 20000000
    UNION ALL SELECT id, 'no-manual', 0 FROM libraries WHERE id NOT IN (SELECT library_id FROM manuals) UNION ALL SELECT id, 'unknown-version', nki_count FROM libraries WHERE required_version = '' AND nki_count > 0 UNION ALL SELECT id, 'no-cover', 0 FROM libraries WHERE cover_file = ''""")
def health_issues(c):
    return R.issues(c("libraries"), c("junk"), c("manuals"))


@query("health_summary", "libraries", "SELECT count(*) AS libraries, count(*) FILTER (root_id = 4) AS missing_path, count(*) FILTER (root_id <> 4 AND cover_file = '') AS no_cover, count(*) FILTER (root_id <> 4 AND required_version = '') AS unknown_version, count(*) FILTER (root_id <> 4 AND junk_count > 0) AS junk FROM libraries")
def health_summary(c):
    """A library whose path is missing counts for nothing else."""
    there = F.col("root_id") != 4
    return c("libraries").agg(F.count("*").alias("libraries"), F.count_if(~there).alias("missing_path"), F.count_if(there & (F.col("cover_file") == "")).alias("no_cover"), F.count_if(there & (F.col("required_version") == "")).alias("unknown_version"), F.count_if(there & (F.col("junk_count") > 0)).alias("junk"))


_DUPS = """g AS (SELECT sha256(text) AS fp, n_chars, count(*) AS files, min(source) AS library FROM documents WHERE n_chars >= 50 GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT source) >= 2),
    dg AS (SELECT fp, library, n_chars * (files - 1) AS reclaimable FROM g)"""


@query("suggestions", "libraries registered manuals", f"""WITH n AS (SELECT DISTINCT library_id, lower(name) AS name FROM ({_NAMES})), k AS (SELECT library_id, count(*) AS k FROM n GROUP BY 1), s AS (SELECT a.library_id AS a, b.library_id AS b, count(*) AS s FROM n a JOIN n b ON a.name = b.name AND a.library_id < b.library_id GROUP BY 1, 2),
    pair AS (SELECT a, b, s::DOUBLE / (ka.k + kb.k - s) AS j FROM s JOIN k ka ON ka.library_id = a JOIN k kb ON kb.library_id = b WHERE s >= 0.55 * (ka.k + kb.k - s) - 1e-9 AND a IN (SELECT id FROM libraries) AND b IN (SELECT id FROM libraries)),
    {_DUPS},
    p AS (SELECT 'register' AS kind, name, 0 AS size FROM libraries WHERE has_nicnt AND concat('k', CAST(id AS STRING)) NOT IN (SELECT lower(reg_key) FROM registered) UNION ALL SELECT 'kb', name, 0 FROM libraries WHERE id % 4 <> 0 AND id IN (SELECT library_id FROM manuals)
    UNION ALL SELECT 'junk', name, junk_bytes FROM libraries WHERE junk_bytes > 52428800 UNION ALL SELECT 'cover', name, 0 FROM libraries WHERE has_nicnt AND cover_file = '' UNION ALL SELECT 'nonstandard', name, 0 FROM libraries WHERE NOT has_nicnt UNION ALL SELECT 'unclassified', name, 0 FROM libraries WHERE trim(category) = ''),
    top AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY size DESC, name) AS rn FROM p),
    pt AS (SELECT la.name AS na, lb.name AS nb, row_number() OVER (ORDER BY j DESC, a, b) AS rn FROM pair JOIN libraries la ON la.id = a JOIN libraries lb ON lb.id = b),
    sides AS (SELECT na AS name, 0 AS side, rn FROM pt WHERE rn <= 8 UNION ALL SELECT nb, 1, rn FROM pt WHERE rn <= 8), once AS (SELECT name, min(side * 100 + rn) AS o FROM sides GROUP BY 1),
    dt AS (SELECT library, row_number() OVER (ORDER BY reclaimable DESC, library, fp) AS rn FROM dg), m AS (
    SELECT kind, count(*) AS n, CASE kind WHEN 'register' THEN 1000000 + count(*) WHEN 'kb' THEN 900000 + count(*) WHEN 'junk' THEN 600000 + sum(size) // 1048576 WHEN 'cover' THEN 300000 + count(*) WHEN 'nonstandard' THEN 200000 + count(*) ELSE 100000 + count(*) END AS weight, string_agg(name, ',' ORDER BY rn) FILTER (rn <= 8) AS samples FROM top GROUP BY 1
    UNION ALL SELECT 'similar', count(*), 700000 + count(*), (SELECT string_agg(name, ',' ORDER BY o) FROM once) FROM pair HAVING count(*) > 0
    UNION ALL SELECT 'duplicates', count(*), 500000 + sum(reclaimable) // 1048576, (SELECT string_agg(library, ',' ORDER BY rn) FROM dt WHERE rn <= 5) FROM dg HAVING count(*) > 0) SELECT kind, n, CAST(weight AS BIGINT) AS weight, samples FROM m""")
def suggest(c):
    """All eight rules; what stands beside the libraries is as in ``batch_dsl_expand``."""
    from sonaria.operators.dedup import duplicate_files
    from sonaria.operators.relational import similar_pairs

    libraries, related, names = _related(c)
    pairs = similar_pairs(names.select("library_id", F.lower("name").alias("name")), "library_id", "name", R.DUPLICATE)
    known = c("libraries").select("id")
    pairs = pairs.join(known.withColumnRenamed("id", "a"), "a").join(known.withColumnRenamed("id", "b"), "b").withColumn("jaccard", F.col("shared") / (F.col("ka") + F.col("kb") - F.col("shared")))
    files = c.table("documents").select("doc_id", F.col("source").alias("library"), F.col("n_chars").alias("size_bytes"), "text")
    groups = duplicate_files(files, least=50)
    first = files.select(F.sha2("text", 256).alias("fp"), "size_bytes", "library").groupBy("fp", "size_bytes").agg(F.min("library").alias("library"))
    return R.suggestions(libraries, related, pairs, groups.join(first, ["fp", "size_bytes"]).select("fp", "library", "reclaimable"))


_STATUS = """WITH l AS (SELECT id, path, has_nicnt, CASE WHEN id % 16 = 7 THEN '' WHEN id % 8 = 3 THEN concat('K', id + 1, ';AB') ELSE concat('k', id) END AS keys FROM libraries),
    o AS (SELECT l.id, min(r.reg_key) AS reg_key, max(r.in64) AS in64, bool_and(CAST(substring(r.reg_key, 2) AS BIGINT) % 5 <> 0) AS recorded, bool_or(CAST(substring(r.reg_key, 2) AS BIGINT) % 7 <> 0) AS managed FROM l JOIN registered r ON r.content_dir = l.path OR starts_with(r.content_dir, l.path || '/') GROUP BY 1),
    e AS (SELECT l.id, min(split_part(keys, ';', 1)) AS moved FROM l JOIN registered r ON lower(r.reg_key) = lower(split_part(keys, ';', 1)) GROUP BY 1),
    s AS (SELECT l.id, coalesce(o.reg_key, e.moved) AS reg_key, has_nicnt, recorded, managed, CASE WHEN o.reg_key IS NOT NULL AND NOT o.in64 THEN 'partial' WHEN o.reg_key IS NOT NULL THEN 'registered' WHEN keys = '' THEN 'non-standard' WHEN e.moved IS NOT NULL THEN 'path-mismatch' ELSE 'missing' END AS s FROM l LEFT JOIN o ON l.id = o.id LEFT JOIN e ON l.id = e.id),
    t AS (SELECT *, CASE WHEN has_nicnt AND s IN ('registered', 'partial') AND NOT recorded THEN 'incomplete' ELSE s END AS t FROM s)
    SELECT id, reg_key, CASE WHEN t IN ('registered', 'incomplete') AND NOT managed THEN 'pending-manager' ELSE t END AS status FROM t"""


def _registration(c):
    """Some libraries name another's product, with a short mark, or none; every fifth product has no record
    and every seventh is not in the manager's list."""
    key = F.when(F.col("id") % 16 == 7, "").when(F.col("id") % 8 == 3, F.concat(F.lit("K"), (F.col("id") + 1).cast("string"), F.lit(";AB"))).otherwise(F.concat(F.lit("k"), F.col("id").cast("string")))
    number = F.substring("reg_key", 2, 20).cast("long")
    return R.registration(c("libraries").withColumn("product_key", key), c("registered"), c("registered").where(number % 5 != 0), c("registered").where(number % 7 != 0))


@query("registration_status", "libraries registered", _STATUS)
def registration_status(c):
    return _registration(c)


@query("registration_report", "libraries registered", f"SELECT status, count(*) AS n FROM ({_STATUS}) GROUP BY 1")
def registration_report(c):
    return _registration(c).groupBy("status").agg(F.count("*").alias("n"))


@query("compat_status", "libraries", "SELECT id, CASE WHEN required_version = '' THEN 'unknown' WHEN (CAST(split_part(required_version, '.', 1) AS INT), CAST(split_part(required_version, '.', 2) AS INT)) > (6, 4) OR (split_part(required_version, '.', 1) = '6' AND split_part(required_version, '.', 2) = '4' AND split_part(required_version, '.', 3) <> '0') THEN 'too-old' ELSE 'ok' END AS status FROM libraries")
def compat_status(c):
    from sonaria.functions import scalars as S

    v = F.col("required_version")
    return c("libraries").select("id", F.when(~S.version_valid(v), "unknown").when(S.version_key(v) > S.version_key(F.lit("6.4.0")), "too-old").otherwise("ok").alias("status"))


@query("view_misplacement", "registered", "SELECT reg_key FROM registered WHERE NOT in64 AND (in32 OR in_user)")
def view_misplacement(c):
    return R.misplaced(c("registered")).select("reg_key")


@query("orphan_products", "registered libraries", """WITH p AS (SELECT *, CAST(substring(reg_key, 2) AS BIGINT) AS n FROM registered), f AS (SELECT path FROM libraries WHERE root_id <> 3 UNION SELECT split_part(path, '/', 1) FROM libraries WHERE root_id <> 3),
    o AS (SELECT reg_key, content_dir, in64, in32, in_user, CASE WHEN n % 3 = 1 THEN 'index' ELSE 'hint' END AS evidence FROM p WHERE content_dir NOT IN (SELECT path FROM f) AND (n % 3 = 1 OR n % 4 < 2))
    SELECT view, reg_key, content_dir, evidence FROM (SELECT *, unnest(['in64', 'in32', 'in_user']) AS view, unnest([in64, in32, in_user]) AS held FROM o) WHERE held""")
def orphan_products(c):
    """Every third product is in the index; the hints of two in four say what they are."""
    n = F.substring("reg_key", 2, 20).cast("long")
    bodies = F.concat(F.lit("<Product><Type>"), F.when(n % 4 < 2, "Content").otherwise("Plugin"), F.lit("</Type></Product>"))
    hints = c("registered").select("reg_key", bodies.alias("body"))
    return M.orphan_products(c("registered"), c("libraries").where("root_id <> 3").select("path"), c("registered").where(n % 3 == 1), hints, ["<Type>Content</Type>"], ["in64", "in32", "in_user"])


_CLAIMS = [("found_count", "NATION_1", 3), ("found_count", "NATION_2", 4000), ("found_count", "NATION_2", 4000), ("found_count", "none", 1)]


@query("assert_claims", "libraries", f"WITH c(kind, subject, n) AS (VALUES {', '.join(repr(x) for x in _CLAIMS)}), d AS (SELECT DISTINCT kind, subject, n FROM c) SELECT kind, subject, CAST(n AS BIGINT) AS claimed, (SELECT count(*) FROM libraries WHERE category = subject) AS total, n > (SELECT count(*) FROM libraries WHERE category = subject) AS fails FROM d")
def assert_claims(c):
    """Each claim once; it fails only where it says more than there is."""
    claims = c.spark.createDataFrame(_CLAIMS, "kind string, subject string, claimed long").distinct()
    totals = c("libraries").groupBy(F.col("category").alias("subject")).agg(F.count("*").alias("total"))
    rows = claims.join(totals, "subject", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    return rows.select("kind", "subject", "claimed", "total", (F.col("claimed") > F.col("total")).alias("fails"))


_SCORE = """CASE WHEN is_primary THEN 100 ELSE 0 END + CASE ext WHEN 'pdf' THEN 50 WHEN 'chm' THEN 30 WHEN 'epub' THEN 20 ELSE 0 END + CASE WHEN regexp_matches(lower(name), 'english|_en') THEN 40 ELSE 0 END
    - CASE WHEN regexp_matches(lower(name), 'deutsch|_de|francais|_fr|espanol|_es') THEN 40 ELSE 0 END + CASE WHEN contains(lower(name), 'manual') THEN 25 ELSE 0 END + CASE WHEN contains(lower(name), 'guide') THEN 20 ELSE 0 END + CASE WHEN contains(lower(name), 'reference') THEN 15 ELSE 0 END
    + CASE WHEN contains(lower(name), 'handbook') THEN 5 ELSE 0 END - CASE WHEN regexp_matches(lower(name), 'license|readme|changelog') THEN 30 ELSE 0 END + CASE WHEN size_bytes > 1048576 THEN 5 ELSE 0 END - CASE WHEN size_bytes < 20480 THEN 20 ELSE 0 END"""
_MANUALS = f"""WITH m AS (SELECT *, {_SCORE} AS score, row_number() OVER (PARTITION BY library_id ORDER BY is_primary DESC, size_bytes DESC, name, id) AS rn FROM manuals),
    p AS (SELECT library_id, count(*) AS manuals, arg_min(name, (-score, name)) AS best, string_agg(name, ',' ORDER BY rn) FILTER (rn <= 8) AS listed FROM m GROUP BY 1)
    SELECT l.id, l.name, coalesce(p.manuals, 0) AS manuals, coalesce(p.best, '') AS best, coalesce(l.id % 4 = 0 AND p.manuals > 0, false) AS built, coalesce(p.listed, '') AS listed FROM libraries l LEFT JOIN p ON p.library_id = l.id"""


def _manuals_status(c):
    """The base of every fourth library is as new as its manual."""
    manuals = c("manuals").withColumn("mtime", F.lit(5))
    bases = manuals.select("library_id", F.col("name").alias("manual_name"), F.when(F.col("library_id") % 4 == 0, 5).otherwise(4).alias("built")).distinct()
    return R.manuals_status(c("libraries"), manuals, bases)


@query("list_manuals_status", "libraries manuals", _MANUALS)
def list_manuals_status(c):
    return _manuals_status(c).withColumn("listed", F.array_join("listed", ","))


@query("list_manuals_totals", "libraries manuals", f"SELECT count(*) AS libraries, CAST(sum(manuals) AS BIGINT) AS manuals, count(*) FILTER (built) AS built, count(*) FILTER (NOT built AND manuals > 0) AS missing, count(*) > 60 AS compact FROM ({_MANUALS})")
def list_manuals_totals(c):
    return R.manuals_totals(_manuals_status(c))


@query("required_args", "trace", "SELECT id, CASE tool_name WHEN 'click' THEN 'target' WHEN 'view' THEN 'page,size' ELSE '' END AS missing FROM trace")
def required_args(c):
    need = F.when(F.col("tool_name") == "click", F.array(F.lit("k"), F.lit("target"))).when(F.col("tool_name") == "view", F.array(F.lit("size"), F.lit("page"))).otherwise(F.array(F.lit("k")))
    return c("trace").select("id", F.array_join(R.missing_keys(F.col("args"), need), ",").alias("missing"))


@query("snapshot_list", "registered", """WITH s AS (SELECT *, CAST(substring(reg_key, 2) AS BIGINT) // 40 AS day FROM registered), n AS (SELECT day, count(*) FILTER (in64) + count(*) FILTER (in32) + count(*) FILTER (in_user) AS n FROM s GROUP BY 1)
    SELECT concat('snapshot-', lpad(CAST(day AS STRING), 9, '0')) AS name, CASE WHEN day % 7 = 6 THEN 'file time' ELSE concat('day ', day) END AS created_at, CASE WHEN day % 7 = 6 THEN '' ELSE 'before import' END AS reason, CASE WHEN day % 7 = 6 THEN 0 ELSE n END AS products, day % 7 <> 6 AND day % 2 = 0 AS portable FROM n""")
def snapshot_list(c):
    """Snapshots of the registered products, up to forty in each, as the JSON that a capture writes; the content of
    every seventh is cut off. A product that is registered twice counts once in a view."""
    day = F.floor(F.substring("reg_key", 2, 20).cast("long") / 40)
    views = ("in64", "in32", "in_user")
    once = c("registered").groupBy("reg_key").agg(F.min("content_dir").alias("content_dir"), *[F.max(F.coalesce(F.col(v), F.lit(False))).alias(v) for v in views])
    view = lambda name: F.map_from_entries(F.collect_list(F.when(F.col(name), F.struct("reg_key", F.create_map(F.lit("content_dir"), F.col("content_dir"))))))
    per = once.groupBy(day.alias("day")).agg(*[view(v).alias(v) for v in views])  # forty products
    registry = F.create_map(*[x for v in views for x in (F.lit(v), F.col(v))])
    text = F.to_json(F.struct(F.concat(F.lit("day "), F.col("day").cast("string")).alias("created_at"), F.lit("before import").alias("reason"), registry.alias("registry"), F.when(F.col("day") % 2 == 0, "c2V0").alias("settings")))
    files = per.select(F.concat(F.lit("snapshot-"), F.lpad(F.col("day").cast("string"), 9, "0")).alias("name"), F.lit("file time").alias("modified"), F.when(F.col("day") % 7 == 6, F.lit("{")).otherwise(text).alias("content"))
    return R.snapshots(files)


@query("repeat_suffix_stuck", "", """WITH t AS (SELECT doc_id, text, right(text, 160) AS tail FROM documents), a AS (SELECT *, CASE WHEN length(text) >= 640 THEN strpos(text, tail) ELSE 0 END AS p FROM t), b AS (SELECT doc_id, tail, CASE WHEN p > 0 THEN substring(text, p + 1) ELSE '' END AS rest FROM a),
    d AS (SELECT doc_id, tail, rest, strpos(rest, tail) AS p FROM b), e AS (SELECT doc_id, tail, CASE WHEN p > 0 THEN substring(rest, p + 1) ELSE '' END AS rest FROM d), f AS (SELECT doc_id, tail, rest, strpos(rest, tail) AS p FROM e), g AS (SELECT doc_id, tail, CASE WHEN p > 0 THEN substring(rest, p + 1) ELSE '' END AS rest FROM f)
    SELECT doc_id, rest <> '' AND strpos(rest, tail) > 0 AS stuck FROM g""")
def repeat_suffix_stuck(c):
    return c.table("documents").select("doc_id", R.suffix_stuck(F.col("text")).alias("stuck"))


@query("move_plan_report", "libraries roots registered", """WITH m AS (SELECT l.id AS library_id, CASE WHEN l.id % 7 = 0 THEN 'nowhere' WHEN l.id % 7 = 1 THEN 'Shelf/New' WHEN l.id % 11 = 5 THEN l.path ELSE r.path END AS dest_root FROM libraries l JOIN roots r ON r.id = l.id % 5 UNION ALL SELECT id + 1000000, 'Shelf/New' FROM libraries WHERE id % 50 = 0),
    f AS (SELECT path FROM libraries WHERE root_id <> 3 UNION SELECT path FROM roots UNION SELECT unnest(['Shelf', 'Shelf/New']) UNION SELECT concat(r.path, '/', l.name) FROM libraries l JOIN roots r ON r.id = l.id % 5 WHERE l.id % 10 = 0),
    free AS (SELECT path, CASE WHEN id = 1 THEN 5000000000 ELSE 1000000000000 END AS free_bytes FROM roots WHERE id <> 2 UNION ALL SELECT 'Shelf/New', 1000000000000),
    k AS (SELECT l.id, lower(r.reg_key) AS k FROM libraries l JOIN registered r ON r.content_dir = l.path OR starts_with(r.content_dir, l.path || '/') UNION SELECT id, CASE WHEN id % 16 = 7 THEN lower(name) ELSE concat('k', id) END FROM libraries WHERE has_nicnt),
    n AS (SELECT id, count(*) AS n FROM k GROUP BY 1),
    j AS (SELECT m.library_id, m.dest_root, l.id IS NOT NULL AS found, concat(m.dest_root, '/', l.name) AS dest_path, l.path, l.size_bytes, l.file_count, coalesce(n.n, 0) AS products, l.path IN (SELECT path FROM f) AS src, m.dest_root IN (SELECT path FROM f) AS root, concat(m.dest_root, '/', l.name) IN (SELECT path FROM f) AS dest, m.dest_root IN (SELECT path FROM roots) AS known, free.free_bytes AS free
        FROM m LEFT JOIN libraries l ON l.id = m.library_id LEFT JOIN n ON n.id = m.library_id LEFT JOIN free ON free.path = m.dest_root)
    SELECT library_id, dest_root, CASE WHEN found THEN dest_path ELSE '' END AS dest_path, coalesce(size_bytes, 0) AS size_bytes, coalesce(file_count, 0) AS file_count, products,
        CASE WHEN NOT found THEN 'no-library' ELSE concat_ws(',', CASE WHEN NOT src THEN 'no-source' END, CASE WHEN NOT root THEN 'no-dest-root' END, CASE WHEN root AND dest THEN 'exists' END, CASE WHEN root AND starts_with(dest_path, path || '/') THEN 'nested' END, CASE WHEN root AND free < floor(size_bytes * 1.02::DOUBLE) + 52428800 THEN 'no-space' END) END AS errors,
        CASE WHEN NOT found THEN '' ELSE concat_ws(',', CASE WHEN root AND NOT known THEN 'unknown-root' END, CASE WHEN root AND free IS NULL THEN 'free-space-unknown' END, 'running', CASE WHEN products = 0 THEN 'no-products' END) END AS warnings FROM j""")
def move_plan_report(c):
    """Every library to another place: roots, a shelf that is no root, a place that is not there, or into itself."""
    paths = c("roots").select(F.col("id").alias("k"), F.col("path").alias("root"))
    rows = c("libraries").withColumn("k", F.col("id") % 5).join(paths, "k")
    to = F.when(F.col("id") % 7 == 0, "nowhere").when(F.col("id") % 7 == 1, "Shelf/New").when(F.col("id") % 11 == 5, F.col("path")).otherwise(F.col("root"))
    moves = rows.select(F.col("id").alias("library_id"), to.alias("dest_root")).union(c("libraries").where("id % 50 = 0").select(F.col("id") + 1_000_000, F.lit("Shelf/New")))
    taken = rows.where("id % 10 = 0").select(F.concat_ws("/", "root", "name").alias("path"))
    shelf = c.spark.createDataFrame([("Shelf/New",)], "path string")
    folders = c("libraries").where("root_id <> 3").select("path").union(c("roots").select("path")).union(shelf).union(taken)
    free = c("roots").where("id <> 2").select("path", F.when(F.col("id") == 1, 5_000_000_000).otherwise(1_000_000_000_000).alias("free_bytes")).union(shelf.withColumn("free_bytes", F.lit(1_000_000_000_000)))
    libraries = c("libraries").withColumn("product_key", F.when(F.col("id") % 16 == 7, "").otherwise(F.concat(F.lit("K"), F.col("id").cast("string"))))
    made = M.move_plans(moves, libraries, c("roots"), folders, free, c("registered"), running=True)
    return made.withColumns({k: F.array_join(k, ",") for k in ("errors", "warnings")})


@query("diagnostics_parse", "trace", "SELECT id, CASE WHEN ok THEN 'warning' ELSE 'error' END AS severity, CAST(id % 100 AS INT) AS line, tool_name AS message FROM trace WHERE id % 5 <> 0")
def diagnostics_parse(c):
    """Severity, line and message of a tool's output lines; lines of another form are dropped."""
    text = F.when(F.col("id") % 5 == 0, "done").otherwise(F.format_string("%s: line %d: %s", F.when(F.col("ok"), "warning").otherwise("error"), F.col("id") % 100, F.col("tool_name")))
    form = r"^(error|warning): line (\d+)(?::\d+)?: (.*)$"
    rows = c("trace").select("id", text.alias("t")).where(F.col("t").rlike(form))
    part = lambda i: F.regexp_extract("t", form, i)
    return rows.select("id", part(1).alias("severity"), part(2).cast("int").alias("line"), part(3).alias("message"))


@query("plan_steps_normalise", "messages", r"""WITH w AS (SELECT session_id, id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT session_id, id, regexp_split_to_array(content, '[ \t\n\r\f\x0B]+') AS ws FROM messages WHERE content IS NOT NULL)),
    k AS (SELECT *, row_number() OVER (PARTITION BY session_id, id ORDER BY i) AS step FROM w WHERE i % 2 = 1 OR w <> '')
    SELECT session_id, id, CAST(step AS INT) AS step, w AS title, CASE WHEN i % 10 = 0 THEN 'doing' WHEN i % 10 = 2 THEN 'done' WHEN i % 10 = 4 THEN 'blocked' ELSE 'pending' END AS status FROM k WHERE step <= 20""")
def plan_steps_normalise(c):
    """The words of each message as the JSON of a plan's steps: objects, with or without a known status, and texts."""
    words = F.split("content", r"[ \t\n\r\f\x0B]+", -1)
    status = lambda i: F.when(i % 10 == 0, "doing").when(i % 10 == 2, "done").when(i % 10 == 4, "blocked").when(i % 10 == 6, "odd")
    step = lambda w, i: F.when(i % 2 == 0, F.to_json(F.struct(w.alias("title"), status(i).alias("status")))).otherwise(F.regexp_extract(F.to_json(F.array(w)), r"(?s)^\[(.*)\]$", 1))
    text = F.concat(F.lit("["), F.array_join(F.transform(words, step), ","), F.lit("]"))
    rows = c("messages").select("session_id", "id", F.posexplode(R.plan_steps(text)).alias("p", "s"))
    return rows.select("session_id", "id", (F.col("p") + 1).alias("step"), "s.title", "s.status")
