"""Filters over the catalog: searches, lists, picks (predicates and projections)."""

from pyspark.sql import functions as F

from sonaria.functions import scalars as S
from sonaria.operators import listing
from sonaria.plans.registry import query


@query("optional_filter", "instruments", "SELECT id, name FROM instruments WHERE library_id = 5")
def optional_filter(c, library: int = 5):
    rows = c("instruments").select("id", "library_id", "name")
    return (rows.where(F.col("library_id") == library) if library else rows).select("id", "name")


@query("term_and_match", "instruments", "SELECT id FROM instruments WHERE (contains(lower(name), 'red') OR contains(lower(rel_path), 'red')) AND (contains(lower(name), 'small') OR contains(lower(rel_path), 'small'))")
def term_and_match(c, terms: str = "red SMALL"):
    return c("instruments").where(S.term_and_match(F.col("name"), F.col("rel_path"), terms)).select("id")


@query("term_wildcards", "instruments", "SELECT id FROM instruments WHERE name ILIKE '%r_d%g%' OR rel_path ILIKE '%r_d%g%'")
def term_wildcards(c, terms: str = "r_d%g"):
    return c("instruments").where(S.term_and_match(F.col("name"), F.col("rel_path"), terms, wildcards=True)).select("id")


def search_instruments(c, terms="", library=0, category="", kind="", favorites=False, offset=0, limit=100, sort="name"):
    """The filtered instruments with their library, and the page of them asked for."""
    rows = c("instruments").where(S.term_and_match(F.col("name"), F.col("rel_path"), terms, most=6))
    rows = rows.where(F.col("library_id") == library) if library else rows
    rows = rows.where(F.col("kind") == kind) if kind else rows
    rows = rows.join(c("favorites"), rows.id == F.col("instrument_id"), "left_semi") if favorites else rows
    libraries = c("libraries").select(F.col("id").alias("l_id"), F.col("name").alias("library"), "category")
    libraries = libraries.where(F.col("category") == category) if category else libraries
    found = rows.join(libraries, rows.library_id == libraries.l_id).drop("l_id")
    orders = {"name": [F.lower("name"), "id"], "size": [F.desc("size_bytes"), "id"], "library": [F.lower("library"), F.lower("name"), "id"]}
    limit = max(1, min(2000, limit))
    return found, found.orderBy(*orders.get(sort, orders["name"])).offset(offset).limit(limit)


@query(
    "instrument_search",
    "instruments libraries",
    """SELECT i.id, i.name, l.name AS library, i.size_bytes FROM instruments i JOIN libraries l ON i.library_id = l.id
    WHERE contains(lower(i.name), 'widget') AND i.kind = 'nki' ORDER BY lower(i.name), i.id LIMIT 50 OFFSET 10""",
)
def instrument_search(c):
    return search_instruments(c, "widget", kind="nki", offset=10, limit=50)[1].select("id", "name", "library", "size_bytes")


@query("instrument_search_total", "instruments libraries", "SELECT count(*) AS total FROM instruments i JOIN libraries l ON i.library_id = l.id WHERE contains(lower(i.name), 'widget')")
def instrument_search_total(c):
    return search_instruments(c, "widget")[0].agg(F.count("*").alias("total"))


@query(
    "library_query",
    "libraries",
    """SELECT id, name FROM libraries WHERE contains(lower(category), 'nation_1') AND size_bytes BETWEEN 1 * 1073741824 AND 8 * 1073741824::BIGINT
    AND (required_version = '' OR (CAST(split_part(required_version, '.', 1) AS INT), CAST(split_part(required_version, '.', 2) AS INT)) >= (5, 2))""",
)
def library_query(c, category: str = "nation_1", low: float = 1, high: float = 8, version: str = "5.2"):
    """By category, size in GiB and least version; a library of unknown version passes."""
    gib = 1 << 30
    rows = c("libraries").where(F.contains(F.lower("category"), F.lit(category)) & F.col("size_bytes").between(int(low * gib), int(high * gib)))
    new = S.version_key(F.col("required_version")) >= S.version_key(F.lit(version))
    return rows.where((F.col("required_version") == "") | new).select("id", "name")


@query(
    "library_list_filter",
    "libraries tags tag_map",
    """SELECT id, name FROM libraries l WHERE (contains(lower(name), '1') OR contains(lower(category), '1'))
    AND EXISTS (SELECT 1 FROM tag_map m JOIN tags t ON m.tag_id = t.id WHERE m.entity_id = l.id AND t.name IN ('NATION_3', 'NATION_1'))""",
)
def library_list_filter(c, text: str = "1", tags: tuple = ("NATION_3", "NATION_1")):
    tagged = c("tag_map").join(c("tags").where(F.col("name").isin(*tags)), F.col("tag_id") == F.col("id"), "left_semi")
    rows = c("libraries").where(F.contains(F.lower("name"), F.lit(text)) | F.contains(F.lower("category"), F.lit(text)))
    return rows.join(tagged, rows.id == tagged.entity_id, "left_semi").select("id", "name")


@query(
    "semantic_filter",
    "instruments libraries",
    """WITH rows AS (SELECT i.id, i.library_id, i.name, concat_ws(' ', i.name, i.rel_path, l.name) AS hay FROM instruments i JOIN libraries l ON i.library_id = l.id),
    wide AS (SELECT DISTINCT library_id FROM rows WHERE contains(lower(name), 'cold') AND contains(lower(name), 'gear'))
    SELECT id FROM rows WHERE (contains(lower(hay), 'cold') AND contains(lower(hay), 'gear')) OR (library_id % 9 = 0 AND library_id IN (SELECT library_id FROM wide))""",
)
def semantic_filter(c, words: tuple = ("cold", "gear")):
    """All words in the haystack; in the libraries chosen for it, one instrument that has them all lets the others in."""
    libraries = c("libraries").select(F.col("id").alias("l_id"), F.col("name").alias("l_name"))
    rows = c("instruments").join(libraries, F.col("library_id") == F.col("l_id"))
    hit = S.contains_all(F.concat_ws(" ", "name", "rel_path", "l_name"), list(words))
    wide = rows.where(S.contains_all(F.col("name"), list(words)) & (F.col("library_id") % 9 == 0)).select("library_id").distinct().withColumn("let_in", F.lit(True))
    return rows.join(wide, "library_id", "left").where(hit | F.col("let_in")).select("id")


@query(
    "match_field",
    "instruments",
    """SELECT CASE WHEN contains(lower(name), 'small') AND contains(lower(name), 'ring') THEN 'name'
    WHEN contains(lower(concat_ws(' ', name, rel_path)), 'small') AND contains(lower(concat_ws(' ', name, rel_path)), 'ring') THEN 'path' ELSE 'none' END AS evidence, count(*) AS n FROM instruments GROUP BY 1""",
)
def match_field(c):
    return c("instruments").groupBy(S.match_field(F.col("name"), F.col("rel_path"), ["small", "ring"]).alias("evidence")).agg(F.count("*").alias("n"))


_FAR, _NEAR = "|".join(S.FAR_WORDS), "|".join(S.NEAR_WORDS)
_RANK = f"CASE WHEN regexp_matches(lower(concat_ws(' ', name, rel_path)), '{_FAR}') THEN 2 WHEN regexp_matches(lower(concat_ws(' ', name, rel_path)), '{_NEAR}') THEN 0 ELSE 1 END"


@query("mic_rank", "clips", f"SELECT {_RANK} AS rank, count(*) AS n FROM clips GROUP BY 1")
def mic_rank(c):
    return c("clips").groupBy(S.mic_rank(F.col("name"), F.col("rel_path")).alias("rank")).agg(F.count("*").alias("n"))


@query("primary_pick", "clips", f"SELECT id FROM clips WHERE kind <> 'demo' AND ext IN ('ncw','wav','ogg','mp3','aif','aiff') AND NOT regexp_matches(concat(' ', lower(name), ' '), ' and |&|gong|menu|preset|combo|kit') AND {_RANK} < 2")
def primary_pick(c):
    return c("clips").where(S.primary_pick(F.col("name"), F.col("rel_path"), F.col("ext"), F.col("kind"))).select("id")


@query("mic_policy", "clips", f"SELECT library_id, count(*) AS kept FROM clips WHERE kind <> 'demo' AND ext <> 'nkx' AND {_RANK} < 2 GROUP BY 1")
def mic_policy(c):
    """Rows worth hearing; libraries that have none but distant microphones vanish with them."""
    return c("clips").where(S.primary_pick(F.col("name"), F.col("rel_path"), F.col("ext"), F.col("kind"))).groupBy("library_id").agg(F.count("*").alias("kept"))


@query("map_filter", "points", "SELECT clip_id, x, y FROM points WHERE cluster = 3 AND library_id = 2 ORDER BY clip_id LIMIT 500")
def map_filter(c, cluster: int = 3, library: int = 2, limit: int = 500):
    return c("points").where((F.col("cluster") == cluster) & (F.col("library_id") == library)).orderBy("clip_id").limit(limit).select("clip_id", "x", "y")


@query("map_filter_summary", "points", "SELECT count(*) AS matched, least(count(*), 20) AS shown, count(*) > 20 AS truncated FROM points WHERE cluster = 3")
def map_filter_summary(c, cluster: int = 3, limit: int = 20):
    n = F.count("*")
    return c("points").where(F.col("cluster") == cluster).agg(n.alias("matched"), F.least(n, F.lit(limit)).alias("shown"), (n > limit).alias("truncated"))


@query("box_select", "points", "SELECT count(*) AS points, count(DISTINCT library_id) AS libraries FROM points WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.05 AND 0.2")
def box_select(c):
    return c("points").where(F.col("x").between(-0.1, 0.1) & F.col("y").between(-0.05, 0.2)).agg(F.count("*").alias("points"), F.countDistinct("library_id").alias("libraries"))


@query("can_analyze", "clips", "SELECT ext IN ('ncw','wav','ogg','mp3','aif','aiff') AS can, count(*) AS n FROM clips GROUP BY 1")
def can_analyze(c):
    return c("clips").groupBy(S.is_decodable(F.col("ext")).alias("can")).agg(F.count("*").alias("n"))


@query("glob_match", "instruments", "SELECT id FROM instruments WHERE regexp_matches(lower(name), '^s.*r.ng$')")
def glob_match(c, pattern: str = "S*r?ng"):
    return c("instruments").where(S.glob_match(F.col("name"), pattern)).select("id")


@query("kb_is_fresh", "manuals", "SELECT m.id, coalesce(k.size_bytes = m.size_bytes AND k.size_bytes > 0, false) AS fresh FROM manuals m LEFT JOIN (SELECT id, size_bytes + (id % 3) AS size_bytes FROM manuals WHERE id % 4 <> 0) k ON m.id = k.id")
def kb_is_fresh(c):
    built = c("manuals").where("id % 4 <> 0").select(F.col("id").alias("k_id"), (F.col("size_bytes") + F.col("id") % 3).alias("k_size"))
    rows = c("manuals").join(built, F.col("id") == F.col("k_id"), "left")
    return rows.select("id", F.coalesce((F.col("k_size") == F.col("size_bytes")) & (F.col("k_size") > 0), F.lit(False)).alias("fresh"))


@query("dim_majority_filter", "", "WITH d AS (SELECT vec_id, len(embedding) - CASE WHEN vec_id % 9 = 0 THEN 1 ELSE 0 END AS n FROM embeddings), m AS (SELECT n FROM d GROUP BY n ORDER BY count(*) DESC, n LIMIT 1) SELECT vec_id FROM d WHERE n = (SELECT n FROM m)")
def dim_majority_filter(c):
    """Vectors of the most frequent dimension."""
    rows = c.table("embeddings").select("vec_id", (F.size("embedding") - F.when(F.col("vec_id") % 9 == 0, 1).otherwise(0)).alias("n"))
    common = rows.groupBy("n").count().orderBy(F.desc("count"), "n").limit(1).select("n")
    return rows.join(F.broadcast(common), "n", "left_semi").select("vec_id")  # one row


@query("find_audition", "clips libraries", """SELECT c.id, l.name AS library, CASE WHEN contains(lower(c.name), 'clip 12') THEN 'name' ELSE 'path' END AS evidence FROM clips c JOIN libraries l ON c.library_id = l.id
    WHERE (contains(lower(c.name), '12') OR contains(lower(c.rel_path), '12')) ORDER BY c.id LIMIT 100""")
def find_audition(c):
    """Clips of all libraries that match, with where they do."""
    rows = c("clips").where(S.term_and_match(F.col("name"), F.col("rel_path"), "clip 12"))
    libraries = c("libraries").select(F.col("id").alias("library_id"), F.col("name").alias("library"))
    evidence = S.match_field(F.col("name"), F.col("rel_path"), ["clip 12"])
    return rows.join(libraries, "library_id").select("id", "library", F.when(evidence == "name", "name").otherwise("path").alias("evidence")).orderBy("id").limit(100)


@query("audition_list", "clips", f"SELECT id FROM clips WHERE library_id = 3 AND ext <> 'nkx' AND {_RANK} < 2 ORDER BY CASE WHEN kind = 'demo' THEN 0 ELSE 1 END, id LIMIT 30")
def audition_list(c, library: int = 3):
    rows = c("clips").where((F.col("library_id") == library) & S.is_decodable(F.col("ext")) & (S.mic_rank(F.col("name"), F.col("rel_path")) < 2))
    return rows.orderBy(F.when(F.col("kind") == "demo", 0).otherwise(1), "id").limit(30).select("id")


_LISTED = """WITH s AS (SELECT concat(CASE WHEN id % 5 = 0 THEN 'Deep/er/' ELSE '' END, replace(rel_path, ' ', '/')) AS p, string_split(p, '/') AS a, size_bytes FROM instruments),
    d AS (SELECT DISTINCT array_to_string(a[1:n], '/') AS name FROM s, range(1, 8) AS r(n) WHERE n <= len(a) - 1),
    folders AS (SELECT name FROM d WHERE {folders}), files AS (SELECT {name} AS name, size_bytes FROM s WHERE {files})
    SELECT 'folder' AS kind, name, 0 AS size_bytes, (SELECT count(*) FROM folders) AS matched FROM (SELECT name FROM folders ORDER BY name LIMIT 200) UNION ALL
    SELECT 'file', name, size_bytes, (SELECT count(*) FROM files) FROM (SELECT name, size_bytes FROM files ORDER BY size_bytes DESC, name LIMIT 200)"""


def _tree(c):
    """The instruments in deeper folders, some of them too deep for a listing."""
    return c("instruments").select(F.concat(F.when(F.col("id") % 5 == 0, "Deep/er/").otherwise(""), F.replace("rel_path", F.lit(" "), F.lit("/"))).alias("path"), "size_bytes")


@query("directory_listing", "instruments", _LISTED.format(folders="contains(lower(list_last(string_split(name, '/'))), 'e')", name="p", files="len(a) <= 7 AND contains(lower(a[-1]), 'e')"))
def directory_listing(c):
    return listing.directory_listing(_tree(c), "path", "size_bytes", "", "*E*", recursive=True)


@query("directory_listing_one", "instruments", _LISTED.format(folders="len(string_split(name, '/')) = 2 AND starts_with(name, 'Brand#12/')", name="a[2]", files="len(a) = 2 AND a[1] = 'Brand#12'").replace("SELECT name FROM folders ORDER", "SELECT substring(name, 10) AS name FROM folders ORDER"))
def directory_listing_one(c):
    """One folder, without what lies below."""
    return listing.directory_listing(_tree(c), "path", "size_bytes", "brand#12")


@query("path_candidates", "roots libraries", """WITH p AS (SELECT path, label AS name FROM roots UNION SELECT path, name FROM libraries), s AS (SELECT path, name,
    CASE WHEN starts_with(lower(name), 's') THEN 0 WHEN contains(lower(name), 's') THEN 1 WHEN starts_with(lower(path), 's') THEN 2 WHEN contains(lower(path), 's') THEN 3 ELSE 99 END AS score FROM p)
    SELECT path, name, score FROM s WHERE score < 99 ORDER BY score, name, path LIMIT 300""")
def path_candidates(c, prefix: str = "s"):
    paths = c("roots").select("path", F.col("label").alias("name")).union(c("libraries").select("path", "name")).distinct()
    return paths.withColumn("score", S.path_match_score(F.lit(prefix), F.col("name"), F.col("path"))).where("score < 99").orderBy("score", "name", "path").limit(300)


@query("instrument_path_lookup", "instruments libraries", "SELECT i.id, concat_ws('\\', l.path, i.rel_path) AS full_path FROM instruments i JOIN libraries l ON i.library_id = l.id WHERE i.id IN (3, 50, 77)")
def instrument_path_lookup(c):
    libraries = c("libraries").select(F.col("id").alias("library_id"), "path")
    rows = c("instruments").where(F.col("id").isin(3, 50, 77)).join(libraries, "library_id")
    return rows.select("id", S.full_path(F.col("path"), F.col("rel_path")).alias("full_path"))
