"""The documents as bases of knowledge, in Spark and in SQL."""

from pyspark.sql import functions as F

#: A chunk's characters.
CHUNK = 900
#: lines (doc_id, source, page, line): a document's lines that are not empty, its pages.
BASES = """l AS (SELECT doc_id, source, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls FROM documents), lines AS (SELECT doc_id, source, generate_subscripts(ls, 1) AS page, unnest(ls) AS line FROM l)"""


def knowledge_bases(c):
    """library_id, library_name, manual_name, pages, chunks, overview, built_at: every document's lines are pages, cut
    into chunks, the first of them its overview."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: x != "")
    pages = F.transform("lines", lambda t, i: F.struct((i + 1).alias("n"), t.alias("text")))
    cut = lambda t, i: F.transform(F.sequence(F.lit(0), F.floor((F.char_length(t) - 1) / CHUNK).cast("int")), lambda k: F.struct((i + 1).cast("long").alias("page"), F.substring(t, k * CHUNK + 1, F.lit(CHUNK)).alias("text")))
    rows = c.table("documents").select(F.col("doc_id").alias("library_id"), F.col("source").alias("library_name"), F.concat(F.lit("m"), (F.col("doc_id") % 11).cast("string")).alias("manual_name"), lines.alias("lines"))
    return rows.select("library_id", "library_name", "manual_name", pages.alias("pages"), F.flatten(F.transform("lines", cut)).alias("chunks"), F.get("lines", F.lit(0)).alias("overview"), (F.col("library_id") * 7919 % 100003).alias("built_at"))
