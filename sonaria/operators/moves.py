"""What stands against moving a library, and products whose content is gone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonaria.operators.listing import SEPARATOR, ancestors, folders_of, parts_of

#: Room that a move needs beyond the library: a share of its size, and this many bytes.
SPARE_SHARE, SPARE_BYTES = 1.02, 50 << 20


def _key(path: Column) -> Column:
    """A path as it is compared: one kind of separator, none at its end, no case."""
    return F.lower(F.array_join(parts_of(path), SEPARATOR))


def _named(*checks: tuple[str, Column]) -> Column:
    """The names of the checks that hold; unknown ones do not."""
    return F.array_compact(F.array(*[F.when(c, name) for name, c in checks]))


def move_plans(moves: DataFrame, libraries: DataFrame, roots: DataFrame, folders: DataFrame, free: DataFrame, products: DataFrame, running: bool = False, admin: bool = True) -> DataFrame:
    """library_id, dest_root, dest_path, size_bytes, file_count, products, errors, warnings, a row for each move.

    moves (library_id, dest_root), libraries (id, name, path, size_bytes, file_count, has_nicnt, product_key), roots
    (path), folders (path; those above an existing one exist too), free (path of a root, free_bytes), products
    (reg_key, content_dir). Nothing is moved.

    Errors: ``no-library``, which ends the checks and leaves no path and no size; ``no-source``; ``no-dest-root``; and of a target root that exists,
    ``exists`` (a folder of the library's name is there), ``nested`` (one lies in the other), ``no-space`` (less than
    1.02 times the size and 50 MiB). Warnings: ``unknown-root``, ``free-space-unknown``, ``running``, ``not-admin``, ``no-products``
    (none registered at the library's folder or below, and it is no container, which has a key of its own or goes by
    its name). ``products`` counts the different keys, whatever their case. Paths are compared without case and with either separator.
    """
    there = folders_of(folders, "path").select(F.lower("folder").alias("k")).distinct().withColumn("there", F.lit(True))
    held = libraries.select(F.col("id").alias("library_id"), "name", "path", "size_bytes", "file_count", _key(F.col("path")).alias("source"), F.when(F.col("has_nicnt"), F.lower(F.coalesce(F.nullif(F.trim("product_key"), F.lit("")), F.col("name")))).alias("own"))
    at = products.where("reg_key is not null").select(F.lower(F.trim("reg_key")).alias("reg"), _key(F.col("content_dir")).alias("dir"))
    ups = at.select("reg", F.explode(ancestors(parts_of(F.col("dir")))).alias("source"))
    owned = held.select("library_id", "source").join(ups, "source").select("library_id", "reg").union(held.where("own is not null").select("library_id", "own"))
    keys = owned.groupBy("library_id").agg(F.countDistinct("reg").alias("products"))
    rows = moves.select("library_id", "dest_root").join(held.withColumn("found", F.lit(True)), "library_id", "left").join(keys, "library_id", "left")
    rows = rows.withColumn("dest_path", F.concat_ws(SEPARATOR, F.array_join(parts_of(F.col("dest_root")), SEPARATOR), F.col("name"))).withColumn("root", _key(F.col("dest_root"))).withColumn("dest", _key(F.col("dest_path")))
    for mark, by in (("src_there", "source"), ("root_there", "root"), ("dest_there", "dest")):
        rows = rows.join(there.withColumnsRenamed({"k": by, "there": mark}), by, "left").withColumn(mark, F.coalesce(mark, F.lit(False)))
    known = roots.select(_key(F.col("path")).alias("root")).distinct().withColumn("known", F.lit(True))
    room = free.groupBy(_key(F.col("path")).alias("root")).agg(F.min("free_bytes").alias("free_bytes"))
    rows = rows.join(known, "root", "left").join(room, "root", "left")
    need = (F.col("size_bytes") * SPARE_SHARE).cast("long") + SPARE_BYTES
    inside = F.startswith(F.concat("dest", F.lit(SEPARATOR)), F.concat("source", F.lit(SEPARATOR))) | F.startswith(F.concat("source", F.lit(SEPARATOR)), F.concat("dest", F.lit(SEPARATOR)))
    errors = _named(("no-source", ~F.col("src_there")), ("no-dest-root", ~F.col("root_there")), ("exists", F.col("root_there") & F.col("dest_there")), ("nested", F.col("root_there") & (F.col("dest") != F.col("source")) & inside), ("no-space", F.col("root_there") & (F.col("free_bytes") < need)))
    warnings = _named(("unknown-root", F.col("root_there") & F.col("known").isNull()), ("free-space-unknown", F.col("root_there") & F.col("free_bytes").isNull()), ("running", F.lit(running)), ("not-admin", F.lit(not admin)), ("no-products", F.coalesce("products", F.lit(0)) == 0))
    is_there = F.col("found").isNotNull()
    none = F.array().cast("array<string>")
    return rows.select("library_id", "dest_root", F.when(is_there, F.col("dest_path")).otherwise("").alias("dest_path"), F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), F.coalesce("file_count", F.lit(0)).alias("file_count"), F.coalesce("products", F.lit(0)).cast("long").alias("products"), F.when(is_there, errors).otherwise(F.array(F.lit("no-library"))).alias("errors"), F.when(is_there, warnings).otherwise(none).alias("warnings"))


def orphan_products(products: DataFrame, folders: DataFrame, index: DataFrame, hints: DataFrame, marks: list[str], views: list[str]) -> DataFrame:
    """view, reg_key, content_dir, evidence: products of this kind whose content folder is gone, one row for each view.

    products (reg_key, content_dir, and a mark for each of ``views``), folders (path; those above an existing one exist
    too), index (reg_key), hints (reg_key, body). A product is of this kind if the index names it (evidence
    ``index``) or its hint holds one of ``marks`` (``hint``). Those without a folder of content are left alone.
    """
    there = folders_of(folders, "path").select(F.lower("folder").alias("k")).distinct()
    lost = products.withColumn("k", _key(F.col("content_dir"))).where("k <> ''").join(there, "k", "left_anti").withColumn("r", F.lower("reg_key"))
    holds = reduce(lambda a, m: a | F.contains("body", F.lit(m)), marks, F.lit(False))
    named = index.select(F.lower("reg_key").alias("r"), F.lit("index").alias("evidence"))
    hinted = hints.where(holds).select(F.lower("reg_key").alias("r"), F.lit("hint").alias("evidence"))
    kinds = named.union(hinted).groupBy("r").agg(F.max("evidence").alias("evidence"))  # "index" above "hint"
    view = F.explode(F.array_compact(F.array(*[F.when(F.col(v), F.lit(v)) for v in views])))
    return lost.join(kinds, "r").select(view.alias("view"), "reg_key", "content_dir", "evidence")
