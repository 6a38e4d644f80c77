"""Reports of rows nested in groups, in arrays of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonaria.operators.relational import first_rows, nested_blocks

NO_CATEGORY = "uncategorised"


def named(category: str) -> Column:
    return F.coalesce(F.nullif(F.trim(category), F.lit("")), F.lit(NO_CATEGORY))


def counts_with_names(rows: DataFrame, key: str, most: int, sums: dict | None = None) -> DataFrame:
    """key, n, the ``sums``, names: the first names of each key, by name and then id, without gathering a key."""
    own = rows.withColumn("__o", F.struct("name", "id"))
    few = first_rows(own.select(key, "__o"), [key], "__o", most).groupBy(key).agg(F.transform(F.array_sort(F.collect_list("__o")), lambda o: o["name"]).alias("names"))  # ``most`` a key
    return rows.groupBy(key).agg(F.count("*").alias("n"), *[f.alias(n) for n, f in (sums or {}).items()]).join(few, key)


def manuals_tree(manuals: DataFrame, libraries: DataFrame, bases: DataFrame, size: int = 100) -> DataFrame:
    """category, library_id, library_name, manuals, built, block, items, ordered by category, library and block.

    manuals (id, library_id, name, is_primary), libraries (id, name, category), bases (library_id, manual_id, pages;
    one a library). ``items`` (id, name, is_primary, is_source, pages) holds a library's manuals, the primary first, then
    by name and id, ``size`` to a block, so no library need fit in one row. ``built`` says whether its base has pages;
    those count for the manual the base was made from. Manuals without a library's id are left out; those of an unknown
    library stand under no category and no name.
    """
    base = bases.where("pages > 0").groupBy("library_id").agg(F.max(F.struct("pages", "manual_id")).alias("b"))
    own = manuals.where("library_id is not null").select("library_id", "id", "name", F.coalesce("is_primary", F.lit(False)).alias("is_primary"))
    rows = own.join(base, "library_id", "left").withColumn("is_source", F.coalesce(F.col("b.manual_id") == F.col("id"), F.lit(False)))
    item = F.struct("id", "name", "is_primary", "is_source", F.when(F.col("is_source"), F.col("b.pages")).otherwise(0).alias("pages"))
    blocks = nested_blocks(rows.withColumn("o", F.struct((~F.col("is_primary")).alias("later"), "name", "id")), "library_id", "o", item, size)
    per = own.groupBy("library_id").agg(F.count("*").alias("manuals")).join(base, "library_id", "left").select("library_id", "manuals", F.col("b").isNotNull().alias("built"))
    known = libraries.select(F.col("id").alias("library_id"), F.col("name").alias("library_name"), "category")
    full = blocks.join(per, "library_id").join(known, "library_id", "left")
    made = full.select(named("category").alias("category"), "library_id", F.coalesce("library_name", F.lit("")).alias("library_name"), "manuals", "built", "block", "items")
    return made.orderBy("category", "library_name", "library_id", "block")


def manuals_tree_totals(manuals: DataFrame, bases: DataFrame) -> DataFrame:
    """One row: manuals, those of libraries whose base has pages, libraries."""
    built = bases.where("pages > 0").select("library_id").distinct().withColumn("b", F.lit(1))
    per = manuals.where("library_id is not null").groupBy("library_id").agg(F.count("*").alias("n")).join(built, "library_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per.agg(total("n").alias("manuals"), total(F.when(F.col("b") == 1, F.col("n"))).alias("built"), F.count("*").alias("libraries"))


def sessions_tree(sessions: DataFrame, size: int = 100) -> DataFrame:
    """category, sessions, newest, block, items: the sessions (session_id, category, updated_at, messages) of each category.

    Categories come by their newest change, the latest first, then by name; sessions within one likewise, then by id,
    ``size`` to a block. A category that is null or blank is ``uncategorised``; a session without a time comes last.
    """
    rows = sessions.withColumn("category", named("category"))
    order = F.struct((-F.coalesce("updated_at", F.lit(0))).alias("back"), "session_id")
    blocks = nested_blocks(rows.withColumn("o", order), "category", "o", F.struct("session_id", "updated_at", "messages"), size)
    per = rows.groupBy("category").agg(F.count("*").alias("sessions"), F.max("updated_at").alias("newest"))
    return blocks.join(per, "category").select("category", "sessions", "newest", "block", "items").orderBy(F.desc_nulls_last("newest"), "category", "block")
