"""Joins of the catalog: inner, outer, semi, anti, prefix and pair joins."""

from pyspark.sql import functions as F

from sonaria.functions import scalars as S
from sonaria.operators.containment import find_hints, product_keys
from sonaria.operators.relational import longest_prefix, pair_counts
from sonaria.operators.trees import roots_and_depths
from sonaria.plans.registry import query


def _libraries(c):
    return c("libraries").select(F.col("id").alias("library_id"), F.col("name").alias("library"), F.col("path").alias("library_path"), "category")


@query("clip_library_join", "clips libraries", "SELECT l.category, c.kind, count(*) AS n, CAST(sum(c.size_bytes) AS BIGINT) AS bytes FROM clips c JOIN libraries l ON c.library_id = l.id GROUP BY 1, 2")
def clip_library_join(c):
    """Clips are summed by library first, so that the join handles one row per library and kind."""
    sums = c("clips").groupBy("library_id", "kind").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))
    return sums.join(_libraries(c), "library_id").groupBy("category", "kind").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


@query("instrument_library_join", "instruments libraries", "SELECT i.id, l.name AS library, l.category FROM instruments i JOIN libraries l ON i.library_id = l.id")
def instrument_library_join(c):
    return c("instruments").join(_libraries(c), "library_id").select("id", "library", "category")


@query("junk_library_join", "junk libraries", "SELECT j.id, concat_ws('/', l.path, j.kind) AS full_path, j.size_bytes FROM junk j JOIN libraries l ON j.library_id = l.id")
def junk_library_join(c):
    return c("junk").join(_libraries(c), "library_id").select("id", F.concat_ws("/", "library_path", "kind").alias("full_path"), "size_bytes")


@query("manual_library_join", "manuals libraries", "SELECT m.id, concat_ws('/', l.path, m.name) AS full_path FROM manuals m JOIN libraries l ON m.library_id = l.id WHERE m.is_primary")
def manual_library_join(c):
    return c("manuals").where("is_primary").join(_libraries(c), "library_id").select("id", F.concat_ws("/", "library_path", "name").alias("full_path"))


@query("library_root_left_join", "libraries roots", "SELECT l.id, coalesce(r.path, '') AS root FROM libraries l LEFT JOIN (SELECT * FROM roots WHERE enabled) r ON l.root_id = r.id")
def library_root_left_join(c):
    roots = c("roots").where("enabled").select(F.col("id").alias("root_id"), F.col("path").alias("root"))
    return c("libraries").join(roots, "root_id", "left").select("id", F.coalesce("root", F.lit("")).alias("root"))


@query("tag_left_join_count", "tags tag_map", "SELECT t.id, t.name, count(m.tag_id) AS uses FROM tags t LEFT JOIN tag_map m ON t.id = m.tag_id GROUP BY 1, 2")
def tag_left_join_count(c):
    uses = c("tag_map").groupBy(F.col("tag_id").alias("id")).agg(F.count("*").alias("uses"))
    return c("tags").join(uses, "id", "left").select("id", "name", F.coalesce("uses", F.lit(0)).alias("uses"))


@query("library_instrument_tree", "libraries instruments", "SELECT l.id, l.name, CAST(i.id AS VARCHAR) AS instrument_id, i.name AS instrument FROM libraries l LEFT JOIN instruments i ON i.library_id = l.id AND i.kind = 'nki' AND i.size_bytes > 40000")
def library_instrument_tree(c):
    """The condition on instruments is part of the join: libraries without any stay."""
    some = c("instruments").where("kind = 'nki' AND size_bytes > 40000").select(F.col("library_id").alias("l_id"), F.col("id").cast("string").alias("instrument_id"), F.col("name").alias("instrument"))
    return c("libraries").join(some, F.col("id") == F.col("l_id"), "left").select("id", "name", "instrument_id", "instrument")


@query("no_manual_antijoin", "libraries manuals", "SELECT id, name FROM libraries l WHERE NOT EXISTS (SELECT 1 FROM manuals m WHERE m.library_id = l.id AND m.ext = 'pdf')")
def no_manual_antijoin(c):
    return c("libraries").join(c("manuals").where("ext = 'pdf'").select(F.col("library_id").alias("id")), "id", "left_anti").select("id", "name")


@query("favorite_semijoin", "instruments favorites", "SELECT id, name FROM instruments WHERE id IN (SELECT instrument_id FROM favorites)")
def favorite_semijoin(c):
    return c("instruments").join(c("favorites").withColumnRenamed("instrument_id", "id"), "id", "left_semi").select("id", "name")


@query("not_done_antijoin", "clips", "SELECT id FROM clips WHERE ext <> 'nkx' AND id NOT IN (SELECT id FROM clips WHERE size_bytes > 20000)")
def not_done_antijoin(c):
    """Jobs that are left after a stop: all but those whose result is stored."""
    done = c("clips").where("size_bytes > 20000").select("id")
    return c("clips").where("ext <> 'nkx'").join(done, "id", "left_anti").select("id")


@query("on_map_semijoin", "points", "SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT clip_id FROM points WHERE cluster < 4)")
def on_map_semijoin(c):
    return c.table("embeddings").join(c("points").where("cluster < 4").select(F.col("clip_id").alias("vec_id")), "vec_id", "left_semi").select("vec_id")


@query("cascade_delete", "libraries instruments", "SELECT id FROM instruments WHERE library_id NOT IN (SELECT id FROM libraries WHERE root_id = 2)")
def cascade_delete(c, root: int = 2):
    """The instruments that survive the removal of a root."""
    gone = c("libraries").where(F.col("root_id") == root).select(F.col("id").alias("library_id"))
    return c("instruments").join(gone, "library_id", "left_anti").select("id")


@query("scalar_subquery_counts", "roots libraries", "SELECT r.id, (SELECT count(*) FROM libraries l WHERE l.root_id = r.id) AS libraries, (SELECT CAST(coalesce(sum(size_bytes), 0) AS BIGINT) FROM libraries l WHERE l.root_id = r.id AND l.has_nicnt) AS bytes FROM roots r")
def scalar_subquery_counts(c):
    sums = c("libraries").groupBy(F.col("root_id").alias("id")).agg(F.count("*").alias("libraries"), F.sum(F.when(F.col("has_nicnt"), F.col("size_bytes"))).alias("bytes"))
    return c("roots").join(sums, "id", "left").select("id", F.coalesce("libraries", F.lit(0)).alias("libraries"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


_PREFIXES = [("Brand#1", 1), ("Brand#1/SMALL", 2), ("Brand#2", 3), ("Brand#12/LARGE", 4), ("Brand#2/PROMO/red ring", 5)]


@query(
    "prefix_range_join",
    "instruments",
    f"""WITH p(path, owner) AS (VALUES {', '.join(f"('{a}', {b})" for a, b in _PREFIXES)}), m AS (SELECT i.id, p.owner, row_number() OVER (PARTITION BY i.id ORDER BY length(p.path) DESC) AS rn
    FROM instruments i JOIN p ON i.rel_path = p.path OR starts_with(i.rel_path, concat(p.path, '/'))) SELECT id, CAST(owner AS BIGINT) AS owner FROM m WHERE rn = 1""",
)
def prefix_range_join(c):
    owners = c.spark.createDataFrame(_PREFIXES, "path string, owner long")
    return longest_prefix(c("instruments").select("id", "rel_path"), "rel_path", owners, "path").select("id", "owner")


@query("registered_prefix_join", "libraries registered", """WITH m AS (SELECT l.id, min(r.reg_key) AS reg_key FROM libraries l JOIN registered r ON r.content_dir = l.path OR starts_with(r.content_dir, concat(l.path, '/')) GROUP BY l.id) SELECT id, reg_key FROM m""")
def registered_prefix_join(c):
    """The first product whose content is the library's folder or lies below it."""
    products = c("registered").select("reg_key", "content_dir")
    owned = longest_prefix(products, "content_dir", c("libraries").select("id", "path"), "path")
    return owned.groupBy("id").agg(F.min("reg_key").alias("reg_key"))


_N = lambda x: f"regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


@query("name_fallback_join", "libraries registered", f"""WITH p AS (SELECT DISTINCT l.id, r.reg_key FROM libraries l JOIN registered r ON r.content_dir = l.path OR starts_with(r.content_dir, l.path || '/')),
    l AS (SELECT id, {_N("CASE WHEN id % 2 = 0 THEN concat('Vol ', name) ELSE substring(name, 5) END")} AS plain FROM libraries WHERE id NOT IN (SELECT id FROM p)),
    k AS (SELECT DISTINCT reg_key, {_N("replace(reg_key, 'K', 'Supplier#00000000')")} AS key FROM registered),
    n AS (SELECT l.id, k.reg_key FROM l JOIN k ON length(key) >= 8 AND plain <> '' AND (ends_with(plain, key) OR ends_with(key, plain))),
    e AS (SELECT id, reg_key, 0 AS way FROM p UNION ALL SELECT id, reg_key, 1 FROM n UNION ALL SELECT id, concat('k', CAST(id AS STRING)), 2 FROM libraries WHERE has_nicnt)
    SELECT id, min_by(reg_key, way) AS reg_key, ['path', 'name', 'container'][min(way) + 1] AS how FROM e GROUP BY id, lower(reg_key)""")
def name_fallback_join(c):
    """By path; only without one by names of which one ends with the other; and the containers' keys besides."""
    name = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Vol "), "name")).otherwise(F.substring("name", 5, 100))
    libraries = c("libraries").select("id", name.alias("name"), "path")
    products = c("registered").select(F.replace("reg_key", F.lit("K"), F.lit("Supplier#00000000")).alias("reg_key"), "content_dir")
    containers = c("libraries").where("has_nicnt").select("id", F.concat(F.lit("supplier#00000000"), F.col("id").cast("string")).alias("key"))
    found = product_keys(libraries, products, containers, [])
    return found.withColumn("reg_key", F.replace(F.replace("reg_key", F.lit("Supplier#00000000"), F.lit("K")), F.lit("supplier#00000000"), F.lit("k")))


@query("library_pair_selfjoin", "names", "WITH n AS (SELECT DISTINCT library_id, name FROM names) SELECT a.library_id AS a, b.library_id AS b, count(*) AS shared FROM n a JOIN n b ON a.name = b.name AND a.library_id < b.library_id GROUP BY 1, 2")
def library_pair_selfjoin(c):
    return pair_counts(c("names").select("library_id", "name"), "library_id", "name")


@query("branch_trees", "branches", """RECURSIVE WITH r(id, root, depth) AS (SELECT b.id, b.id, CAST(0 AS BIGINT) FROM branches b WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM branches)
    UNION ALL SELECT b.id, r.root, r.depth + 1 FROM branches b JOIN r ON b.parent_id = r.id) SELECT id, root, depth FROM r""")
def branch_trees(c):
    """Every branch with the first branch of its tree and the number of steps to it."""
    return roots_and_depths(c("branches"), "id", "parent_id").select(F.col("node").alias("id"), "root", "depth")


@query("three_level_in", "branches messages trace", """RECURSIVE WITH r(id, root) AS (SELECT b.id, b.id FROM branches b WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM branches) UNION ALL SELECT b.id, r.root FROM branches b JOIN r ON b.parent_id = r.id),
    m AS (SELECT session_id AS id, count(*) AS n FROM messages GROUP BY 1), t AS (SELECT session_id AS id, count(*) AS n FROM trace GROUP BY 1)
    SELECT s.session_id, count(*) AS branches, CAST(coalesce(sum(m.n), 0) AS BIGINT) AS messages, CAST(coalesce(sum(t.n), 0) AS BIGINT) AS steps FROM r JOIN branches s ON s.id = r.root LEFT JOIN m ON m.id = r.id LEFT JOIN t ON t.id = r.id WHERE s.session_id % 5 = 2 GROUP BY 1""")
def three_level_in(c):
    """Branches, messages and tool calls of sessions: a branch is of the session its tree began in, and messages
    and calls name their branch. Messages and calls are counted by branch before they are joined."""
    branches = c("branches")
    chosen = branches.where("session_id % 5 = 2").select(F.col("id").alias("root"), "session_id")
    held = roots_and_depths(branches, "id", "parent_id").join(chosen, "root").select(F.col("node").alias("id"), "session_id")
    count = lambda name, label: c(name).groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias(label))
    rows = held.join(count("messages", "m"), "id", "left").join(count("trace", "t"), "id", "left")
    return rows.groupBy("session_id").agg(F.count("*").alias("branches"), F.coalesce(F.sum("m"), F.lit(0)).alias("messages"), F.coalesce(F.sum("t"), F.lit(0)).alias("steps"))


@query("installs_merge", "registered", """WITH r AS (SELECT content_dir AS path, 0 AS priority, reg_key FROM registered WHERE in64 UNION ALL SELECT content_dir, 1, reg_key FROM registered WHERE in32),
    k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY priority, reg_key) AS rn FROM r WHERE reg_key <> 'K4') SELECT path, reg_key, priority FROM k WHERE rn = 1""")
def installs_merge(c):
    """Stored entries before detected ones, without those that are hidden."""
    stored = c("registered").where("in64").select(F.col("content_dir").alias("path"), F.lit(0).alias("priority"), "reg_key")
    found = c("registered").where("in32").select(F.col("content_dir").alias("path"), F.lit(1).alias("priority"), "reg_key")
    hidden = c.spark.createDataFrame([("K4",)], "reg_key string")
    best = F.min(F.struct("priority", "reg_key")).alias("best")
    return stored.union(found).join(F.broadcast(hidden), "reg_key", "left_anti").groupBy("path").agg(best).select("path", "best.reg_key", "best.priority")


@query("registered_products_merge", "registered", """SELECT reg_key, max(in64) AS in64, max(in32) AS in32, max(in_user) AS in_user, min_by(content_dir, v) AS content_dir FROM (
    SELECT reg_key, in64, false AS in32, false AS in_user, content_dir, 0 AS v FROM registered WHERE in64 UNION ALL SELECT reg_key, false, in32, false, content_dir, 1 FROM registered WHERE in32
    UNION ALL SELECT reg_key, false, false, in_user, content_dir, 2 FROM registered WHERE in_user) GROUP BY reg_key""")
def registered_products_merge(c):
    """One row per product of three views: any of the flags, the first value that is not blank."""
    rows = c("registered")
    parts = [rows.where(flag).select("reg_key", *[(F.lit(True) if f == flag else F.lit(False)).alias(f) for f in ("in64", "in32", "in_user")], "content_dir", F.lit(i).alias("v")) for i, flag in enumerate(("in64", "in32", "in_user"))]
    merged = parts[0].union(parts[1]).union(parts[2])
    first = F.min(F.when(F.col("content_dir") != "", F.struct("v", "content_dir")))["content_dir"]
    return merged.groupBy("reg_key").agg(F.max("in64").alias("in64"), F.max("in32").alias("in32"), F.max("in_user").alias("in_user"), first.alias("content_dir"))


@query("hint_match", "libraries tags", f"""WITH h AS (SELECT id AS hint, {_N('name')} AS o FROM tags), l AS (SELECT DISTINCT id, own FROM (SELECT id, unnest([{_N('CASE WHEN id % 3 = 0 THEN category ELSE path END')}, {_N('CASE WHEN id % 5 = 0 THEN substring(category, 1, 7) ELSE name END')}]) AS own FROM libraries) WHERE own <> ''),
    m AS (SELECT id, hint, CASE WHEN own = o THEN 0 ELSE 1 END AS tier FROM l JOIN h ON o <> '' AND (own = o OR length(own) >= 4 AND length(o) >= 4 AND (contains(own, o) OR contains(o, own))))
    SELECT id, min(hint) FILTER (tier = t) AS hint, CASE t WHEN 0 THEN 'equal' ELSE 'contains' END AS how FROM (SELECT *, min(tier) OVER (PARTITION BY id) AS t FROM m) GROUP BY id, t""")
def hint_match(c):
    """The first hint of a library's name or key: an equal name, else one of which one contains the other."""
    name = F.when(F.col("id") % 3 == 0, F.col("category")).otherwise(F.col("path"))
    key = F.when(F.col("id") % 5 == 0, F.substring("category", 1, 7)).otherwise(F.col("name"))
    return find_hints(c("libraries").select("id", name.alias("name"), key.alias("key")), c("tags").select(F.col("id").alias("hint"), "name"))


@query("entry_fallback", "libraries registered", """SELECT l.id, coalesce(nullif(r.content_dir, ''), nullif(l.required_version, ''), 'unknown') AS entry FROM libraries l LEFT JOIN registered r ON r.reg_key = concat('K', CAST(l.id AS STRING)) AND r.in64""")
def entry_fallback(c):
    known = c("registered").where("in64").select(F.col("reg_key"), "content_dir")
    rows = c("libraries").withColumn("reg_key", F.concat(F.lit("K"), F.col("id").cast("string"))).join(known, "reg_key", "left")
    return rows.select("id", F.coalesce(F.nullif("content_dir", F.lit("")), F.nullif("required_version", F.lit("")), F.lit("unknown")).alias("entry"))


@query("unused_cover_files", "libraries", "SELECT concat(CAST(s_suppkey AS STRING), '.png') AS file FROM supplier WHERE concat(CAST(s_suppkey AS STRING), '.png') NOT IN (SELECT concat(CAST(id AS STRING), '.png') FROM libraries WHERE cover_file <> '')")
def unused_cover_files(c):
    kept = c("libraries").where("cover_file <> ''").select(F.concat(F.col("id").cast("string"), F.lit(".png")).alias("file"))
    return c.table("supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".png")).alias("file")).join(kept, "file", "left_anti")


@query("resolve_by_name", "libraries", "SELECT id FROM libraries WHERE contains(lower(name), '00042') ORDER BY CASE WHEN lower(name) = '00042' THEN 0 WHEN starts_with(lower(name), '00042') THEN 1 ELSE 2 END, length(name), id LIMIT 1")
def resolve_by_name(c, text: str = "00042"):
    low = F.lower("name")
    rank = F.when(low == text, 0).when(F.startswith(low, F.lit(text)), 1).otherwise(2)
    return c("libraries").where(F.contains(low, F.lit(text))).orderBy(rank, F.length("name"), "id").limit(1).select("id")
