"""Duplicate files and overlapping libraries."""

from pyspark.sql import functions as F

from sonaria.operators.dedup import classify_relations, duplicate_files, library_similarity
from sonaria.plans.registry import query

_DUP = """WITH f AS (SELECT sha256(text) AS fp, n_chars AS size_bytes, source FROM documents WHERE n_chars >= 50), g AS (SELECT fp, size_bytes, count(*) AS files, count(DISTINCT source) AS libraries FROM f GROUP BY 1, 2)
    SELECT fp, size_bytes, files, libraries, size_bytes * (files - 1) AS reclaimable FROM g WHERE files >= 2 AND libraries >= 2"""


def _files(c):
    return c.table("documents").select("doc_id", F.col("source").alias("library"), F.col("n_chars").alias("size_bytes"), "text")


@query("duplicate_files", "", _DUP)
def duplicates(c):
    return duplicate_files(_files(c), least=50)


@query("dup_reclaim_rollup", "", f"SELECT count(*) AS groups, CAST(sum(reclaimable) AS BIGINT) AS bytes FROM ({_DUP})")
def dup_reclaim_rollup(c):
    return duplicate_files(_files(c), least=50).agg(F.count("*").alias("groups"), F.sum("reclaimable").alias("bytes"))


_PAIRS = """WITH n AS (SELECT DISTINCT library_id, lower(name) AS name FROM names), k AS (SELECT library_id, count(*) AS k FROM n GROUP BY 1),
    s AS (SELECT a.library_id AS a, b.library_id AS b, count(*) AS shared FROM n a JOIN n b ON a.name = b.name AND a.library_id < b.library_id GROUP BY 1, 2),
    j AS (SELECT a, b, shared, ka.k AS ka, kb.k AS kb, round_even(shared / (ka.k + kb.k - shared)::DOUBLE, 3) AS jaccard, round_even(shared / ka.k::DOUBLE, 3) AS cover_a, round_even(shared / kb.k::DOUBLE, 3) AS cover_b FROM s JOIN k ka ON ka.library_id = a JOIN k kb ON kb.library_id = b)"""


@query("library_similarity", "names", _PAIRS + " SELECT a, b, shared, jaccard, cover_a, cover_b FROM j WHERE jaccard >= 0.35")
def similar(c):
    return library_similarity(c("names")).select("a", "b", "shared", "jaccard", "cover_a", "cover_b")


_REL = "CASE WHEN jaccard >= 0.95 THEN 'identical' WHEN greatest(cover_a, cover_b) >= 0.97 AND ka <> kb THEN 'superset' ELSE 'upgrade' END"


@query("classify_relation", "names", _PAIRS + f" SELECT a, b, {_REL} AS relation FROM j WHERE jaccard >= 0.35")
def relations(c):
    return classify_relations(library_similarity(c("names")), _sizes(c)).select("a", "b", "relation")


def _sizes(c):
    """Every library's size and version; the stand-in has equal sizes."""
    return c("names").select(F.col("library_id").alias("id")).distinct().select("id", F.lit(100).cast("long").alias("size_bytes"), F.concat((F.col("id") % 5).cast("string"), F.lit(".0")).alias("version"), (F.col("id") % 2 == 0).alias("registered"))


@query("keep_remove_choice", "names", _PAIRS + """ SELECT a, b, CASE WHEN (a % 2 = 0) <> (b % 2 = 0) THEN CASE WHEN a % 2 = 0 THEN a ELSE b END WHEN a % 5 > b % 5 THEN a WHEN b % 5 > a % 5 THEN b ELSE a END AS keep FROM j WHERE jaccard >= 0.35""")
def keep_remove(c):
    return classify_relations(library_similarity(c("names")), _sizes(c)).select("a", "b", "keep")
