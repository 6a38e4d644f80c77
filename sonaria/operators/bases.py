"""Bases of knowledge: the catalog of them, and many read as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonaria.operators.relational import spread_sums

OVERVIEW = 240


def labelled(name: Column, text: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(name, F.lit("")), F.lit("] "), text)


def catalog(bases: DataFrame, libraries: DataFrame) -> DataFrame:
    """library_id, library_name, category, manual_name, page_count, total_chars, chunk_count, built_at, overview of all
    bases that have a page, the newest first, then by library.

    bases (library_id, manual_name, pages, chunks, overview, built_at), libraries (id, name, category). A base of no
    known library is left out. An overview of more than 240 characters ends there with a mark; null ones are empty.
    """
    size = lambda c: F.greatest(F.size(c), F.lit(0)).cast("long")
    chars = F.aggregate("pages", F.lit(0).cast("long"), lambda n, p: n + F.coalesce(F.char_length(p["text"]), F.lit(0)))
    text = F.coalesce("overview", F.lit(""))
    short = F.when(F.char_length(text) > OVERVIEW, F.concat(F.substring(text, 1, OVERVIEW), F.lit("…"))).otherwise(text)
    rows = bases.where(F.size("pages") > 0).select("library_id", "manual_name", size("pages").alias("page_count"), chars.alias("total_chars"), size("chunks").alias("chunk_count"), "built_at", short.alias("overview"))
    named = libraries.select(F.col("id").alias("library_id"), F.col("name").alias("library_name"), "category")
    return rows.join(named, "library_id").select("library_id", "library_name", "category", *rows.columns[1:]).orderBy(F.desc("built_at"), "library_id")


def merged_chunks(bases: DataFrame) -> DataFrame:
    """id, library_id, page, text: the chunks of all bases as those of one, numbered from 1 by library and place.

    bases (library_id, library_name, chunks); one base a library. The text begins with the library's name in
    brackets, the column ``library_id`` says the same. Numbers come from the bases' numbers of chunks, so the texts
    are not sorted or moved for them. Null chunks and bases without any give none; a null text counts as empty.
    """
    rows = bases.select("library_id", "library_name", F.array_compact("chunks").alias("chunks"))
    sizes = rows.select("library_id", F.greatest(F.size("chunks"), F.lit(0)).cast("long").alias("n"), F.lit(0).alias("all"))
    starts = spread_sums(sizes, "all", "library_id", "n").select("library_id", "__before")
    each = rows.join(starts, "library_id").select("library_id", "library_name", "__before", F.posexplode("chunks").alias("pos", "c"))
    text = labelled(F.col("library_name"), F.coalesce(F.col("c")["text"], F.lit("")))
    return each.select((F.col("__before") + F.col("pos") + 1).cast("long").alias("id"), "library_id", F.col("c")["page"].alias("page"), text.alias("text"))


def merged_totals(bases: DataFrame) -> DataFrame:
    """One row: libraries, page_count, total_chars, chunks, overviews (those that are not empty)."""
    chars = F.aggregate("pages", F.lit(0).cast("long"), lambda n, p: n + F.coalesce(F.char_length(p["text"]), F.lit(0)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    size = lambda c: total(F.greatest(F.size(c), F.lit(0)))
    return bases.agg(F.count("*").alias("libraries"), size("pages").alias("page_count"), total(F.coalesce(chars, F.lit(0))).alias("total_chars"), size("chunks").alias("chunks"), F.count_if(F.coalesce("overview", F.lit("")) != "").alias("overviews"))


def merged_overview(bases: DataFrame) -> DataFrame:
    """library_id, text: the overviews that are not empty under their library's name, in the order of the libraries."""
    rows = bases.where(F.coalesce("overview", F.lit("")) != "")
    return rows.select("library_id", labelled(F.col("library_name"), F.col("overview")).alias("text")).orderBy("library_id")
