"""Scalar functions of the catalog as queries."""

from pyspark.sql import functions as F

from sonaria.functions import scalars as S
from sonaria.operators.rules import rule_list
from sonaria.operators.containment import related_terms as related
from sonaria.plans.registry import query


def _one(name, views, sql, table, key, make):
    query(name, views, f"SELECT {key}, {sql} AS value FROM {table}")(lambda c: c(table).select(key, make().alias("value")))


col = F.col
_one("parent_dir", "instruments", "replace(regexp_replace(rel_path, '/[^/]*$', ''), '/', '\\')", "instruments", "id", lambda: S.parent_dir(col("rel_path")))
_one("leaf_name", "instruments", "split_part(rel_path, '/', 3)", "instruments", "id", lambda: S.leaf_name(col("rel_path")))
_one("group_dir", "instruments", "concat(split_part(rel_path, '/', 1), '\\', split_part(rel_path, '/', 2))", "instruments", "id", lambda: S.group_dir(col("rel_path")))


@query("classify_library", "instruments category_rules", "SELECT id, coalesce((SELECT min_by(class, rank) FROM category_rules WHERE contains(lower(name), word)), 'Other') AS value FROM instruments")
def classify_library(c):
    """The rules are a table of the collection, read once."""
    return c("instruments").select("id", S.classify_library(F.col("name"), rule_list(c("category_rules"))).alias("value"))


@query("classify_articulation", "instruments category_rules", "SELECT id, CASE WHEN kind = 'nkm' THEN 'multi' ELSE coalesce((SELECT min_by(class, rank) FROM category_rules WHERE list_contains(string_split(lower(name), ' '), word)), 'base') END AS value FROM instruments")
def classify_articulation(c):
    return c("instruments").select("id", S.classify_articulation(F.col("name"), F.col("kind"), rule_list(c("category_rules"))).alias("value"))


_one(
    "looks_like_manual",
    "manuals",
    f"CASE WHEN regexp_matches(lower(name), '{S.any_of(S.MANUAL_WORDS)}') THEN true WHEN regexp_matches(lower(name), '{S.any_of(S.NOT_MANUAL_WORDS)}') THEN false ELSE size_bytes >= 51200 END",
    "manuals",
    "id",
    lambda: S.looks_like_manual(col("name"), col("size_bytes")),
)
_one("version_parse", "libraries", "coalesce(array_to_string(list_transform(string_split(nullif(required_version, ''), '.'), lambda v: CAST(CAST(v AS INT) AS VARCHAR)), '-'), '')", "libraries", "id", lambda: F.array_join(F.transform(S.version_parse(col("required_version")), lambda v: v.cast("string")), "-"))
_one("version_compare", "libraries", "CASE WHEN required_version = '' THEN false ELSE (CAST(split_part(required_version, '.', 1) AS INT), CAST(split_part(required_version, '.', 2) AS INT)) >= (4, 7) END", "libraries", "id", lambda: S.version_key(col("required_version")) >= S.version_key(F.lit("4.7")))
_one("version_valid", "libraries", "required_version <> ''", "libraries", "id", lambda: S.version_valid(col("required_version")))
_one("version_guess", "libraries", "regexp_replace(regexp_extract(name, '[0-9][0-9][0-9]$'), '^(.)(.)(.)$', '\\1.\\2.\\3')", "libraries", "id", lambda: S.version_guess(F.regexp_replace(col("name"), r"^.*(\d\d\d)$", "x$1")))
_one("version_sort_key", "libraries", "CASE WHEN required_version = '' THEN 0 ELSE CAST(split_part(required_version, '.', 1) AS BIGINT) * 1000000 + CAST(split_part(required_version, '.', 2) AS BIGINT) * 10000 + CAST(split_part(required_version, '.', 3) AS BIGINT) * 100 END", "libraries", "id", lambda: S.version_sort_key(col("required_version")))
_one("normalize_name", "libraries", "regexp_replace(regexp_replace(lower(name), '^supplier', ''), '[^a-z0-9]', '', 'g')", "libraries", "id", lambda: S.normalize_name(col("name"), ["Supplier"]))
_one("normalize_path", "libraries", "replace(path, '/', '\\')", "libraries", "id", lambda: S.normalize_path(col("path")))
_one("full_path", "libraries", "concat_ws('\\', path, name)", "libraries", "id", lambda: S.full_path(col("path"), col("name")))
_one("format_bytes", "libraries", "CASE WHEN size_bytes >= 1073741824 THEN printf('%.1f GB', size_bytes / 1073741824.0) WHEN size_bytes >= 1048576 THEN printf('%d MB', size_bytes // 1048576) WHEN size_bytes >= 1024 THEN printf('%d KB', size_bytes // 1024) ELSE printf('%d B', size_bytes) END", "libraries", "id", lambda: S.format_bytes(col("size_bytes")))


@query("estimate_tokens", "messages", "SELECT session_id, id, CAST(floor(length(content) / 4) AS BIGINT) + 1 AS value FROM messages")
def estimate_tokens(c):
    return c("messages").select("session_id", "id", S.estimate_tokens(F.col("content")).alias("value"))


_one("edit_similarity", "instruments", "round(1 - levenshtein(name, 'small ring') / greatest(length(name), 10), 6)", "instruments", "id", lambda: F.round(S.edit_similarity(col("name"), F.lit("small ring")), 6))


@query("args_fingerprint")
def args_fingerprint(c):
    return c("trace").select("id", S.args_fingerprint(F.col("args")).alias("value"))


@query("truncate_preview", "messages", "SELECT session_id, id, CASE WHEN length(content) > 300 THEN concat(substring(content, 1, 300), '…') ELSE content END AS value FROM messages")
def truncate_preview(c):
    return c("messages").select("session_id", "id", S.truncate_preview(F.col("content")).alias("value"))


_score = """CASE WHEN is_primary THEN 100 ELSE 0 END + CASE ext WHEN 'pdf' THEN 50 WHEN 'chm' THEN 30 ELSE 0 END + CASE WHEN regexp_matches(lower(name), 'english|_en') THEN 40 ELSE 0 END
    - CASE WHEN regexp_matches(lower(name), 'deutsch|_de|francais|_fr|espanol|_es') THEN 40 ELSE 0 END + CASE WHEN contains(lower(name), 'manual') THEN 25 ELSE 0 END
    - CASE WHEN regexp_matches(lower(name), 'license|readme|changelog') THEN 30 ELSE 0 END + CASE WHEN size_bytes > 1048576 THEN 5 ELSE 0 END - CASE WHEN size_bytes < 20480 THEN 20 ELSE 0 END"""


@query("best_manual_score", "manuals", f"WITH s AS (SELECT library_id, name, id, {_score} AS score FROM manuals), r AS (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY score DESC, name, id) AS rn FROM s) SELECT library_id, id, score FROM r WHERE rn = 1")
def best_manual_score(c):
    score = S.best_manual_score(F.col("name"), F.col("ext"), F.col("size_bytes"), F.col("is_primary"))
    best = F.min(F.struct((-score).alias("s"), "name", "id"))
    return c("manuals").groupBy("library_id").agg(best.alias("b")).select("library_id", "b.id", (-F.col("b.s")).alias("score"))


@query("path_match_score", "libraries", "SELECT id, CASE WHEN starts_with(lower(name), 'nation_1') THEN 0 WHEN contains(lower(name), 'nation_1') THEN 1 WHEN starts_with(lower(path), 'nation_1') THEN 2 WHEN contains(lower(path), 'nation_1') THEN 3 ELSE 99 END AS value FROM libraries")
def path_match_score(c):
    return c("libraries").select("id", S.path_match_score(F.lit("nation_1"), F.col("name"), F.col("path")).alias("value"))


_NOISE, _STOP = ["license", "copyright", "an"], ["the", "and", "est"]
_QUIET = " AND ".join(f"NOT contains(lower(x), '{n}')" for n in [*_NOISE, "。", "？", "！"])


@query("sanitize_keywords", "", f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    l AS (SELECT doc_id, t, list_filter(list_transform(list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: {_QUIET}), lambda x: regexp_extract_all(regexp_replace(x, '^[^:：]{{0,39}}[:：]', ''), '[A-Za-z][A-Za-z0-9-]+')), lambda w: len(w) >= 3)[1] AS f FROM d),
    u AS (SELECT doc_id, unnest(regexp_extract_all(t, '[A-Za-z][A-Za-z0-9-]+')) AS w, unnest(range(len(regexp_extract_all(t, '[A-Za-z][A-Za-z0-9-]+')))) AS pos FROM l WHERE f IS NULL),
    g AS (SELECT doc_id, lower(w) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS rn FROM u WHERE length(w) >= 3 AND lower(w) NOT IN ('the', 'and', 'est') GROUP BY doc_id, lower(w)),
    top AS (SELECT doc_id, string_agg(w, ' ' ORDER BY rn) AS v FROM g WHERE rn <= 12 GROUP BY 1)
    SELECT l.doc_id, CASE WHEN f IS NOT NULL THEN array_to_string(f[1:16], ' ') ELSE coalesce(v, '') END AS value FROM l LEFT JOIN top ON top.doc_id = l.doc_id""")
def sanitize_keywords(c):
    """The first line of keywords of each document, else its most frequent words."""
    from sonaria.operators import text as T

    return T.sanitize_keywords(c.table("documents"), "doc_id", "text", _NOISE, _STOP)


_one("csv_escape", "trace", "CASE WHEN regexp_matches(args, '[\",]') THEN '\"' || replace(args, '\"', '\"\"') || '\"' ELSE args END", "trace", "id", lambda: S.csv_escape(col("args")))
_one("clamp", "instruments", "least(greatest(size_bytes, 5000), 20000)", "instruments", "id", lambda: S.clamp(col("size_bytes"), 5000, 20000))


def _vector(name, sql, make):
    query(name, "", f"SELECT vec_id, {sql} AS value FROM embeddings")(lambda c: c.table("embeddings").select("vec_id", make(F.col("embedding")).alias("value")))


_vector("tanh_squash", "round(list_sum(list_transform(embedding, lambda x: tanh(x::DOUBLE / 10))), 6)", lambda v: F.round(F.aggregate(S.tanh_squash(v), F.lit(0.0), lambda a, x: a + x), 6))
_vector("l2_normalize", "round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6)", lambda v: F.round(F.get(S.l2_normalize(v), F.lit(0)), 6))
_vector("peak_normalize", "round(embedding[1]::DOUBLE / list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) * 0.95, 6)", lambda v: F.round(F.get(S.peak_normalize(v), F.lit(0)), 6))


@query("gain_db")
def gain_db(c):
    return c.table("embeddings").select("vec_id", F.round(S.gain_db(F.col("embedding")), 5).alias("value"))


_one("template_render", "libraries", "concat('Library ', name, ' in ', category)", "libraries", "id", lambda: S.template_render(F.lit("Library %%name%% in %%category%%"), {"name": col("name"), "category": col("category")}))


@query("symbol_category", "trace", "SELECT id, CASE WHEN NOT ok THEN 'callback' WHEN regexp_matches(tool_name, 'array|list') THEN 'arrays' WHEN regexp_matches(tool_name, 'midi|note|event') THEN 'events' ELSE 'general' END AS value FROM trace")
def symbol_category(c):
    kind = F.when(~F.col("ok"), "callback").otherwise("command")
    return c("trace").select("id", S.symbol_category(F.col("tool_name"), kind).alias("value"))


@query("symbol_render", "trace", "SELECT id, concat(tool_name, '(k: int, n: long)') AS value FROM trace")
def symbol_render(c):
    args = F.array(F.struct(F.lit("k").alias("name"), F.lit("int").alias("data_type")), F.struct(F.lit("n").alias("name"), F.lit("long").alias("data_type")))
    return c("trace").select("id", S.symbol_render(F.col("tool_name"), args).alias("value"))


_FAMILIES = [(0, "ring", ["bell", "chime", "ring"]), (1, "gear box", ["cog", "wheel"]), (2, "ed ro", ["stick", "red"]), (3, "rod", ["stick", "bar"])]


@query("related_terms", "instruments", f"""WITH f(rank, word, related) AS (VALUES {', '.join(f"({r}, '{w}', {v})" for r, w, v in _FAMILIES)}), t AS (SELECT DISTINCT lower(trim(split_part(name, ' ', 2))) AS term FROM instruments UNION SELECT DISTINCT lower(trim(name)) FROM instruments),
    m AS (SELECT term, min_by(related, rank) AS related FROM t JOIN f ON contains(term, word) OR contains(word, term) WHERE term <> '' GROUP BY 1)
    SELECT term, array_to_string(list_filter(related, lambda w: NOT contains(term, w)), ',') AS related FROM m""")
def related_terms(c):
    """Related words of names and of their second words, from the first family that is, contains or lies in the term."""
    terms = c("instruments").select(F.explode(F.array(F.split_part("name", F.lit(" "), F.lit(2)), "name")).alias("term"))
    families = c.spark.createDataFrame(_FAMILIES, "rank int, word string, related array<string>")
    return related(terms, families).select("term", F.array_join("related", ",").alias("related"))


@query("overview_question", "messages", "SELECT session_id, id, regexp_matches(lower(content), 'the|and') AND NOT regexp_matches(lower(content), 'tion') AS value FROM messages")
def overview_question(c):
    return c("messages").select("session_id", "id", S.overview_question(F.col("content"), ["the", "and"], ["tion"]).alias("value"))


@query("strip_thinking", "messages", "SELECT session_id, id, trim(content, chr(32)) AS value FROM messages")
def strip_thinking(c):
    """Reasoning goes, whether it is marked at both ends or at its end alone."""
    marked = F.when(F.col("id") % 2 == 0, F.concat(F.lit("<think>why\nnot</think>"), "content")).otherwise(F.concat(F.lit("because </thinking>"), "content"))
    return c("messages").select("session_id", "id", S.strip_thinking(marked).alias("value"))
