"""Folders and files of a listing: scan jobs, directory views and what exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonaria.functions.scalars import glob_match

#: Folders between the listed one and an entry that a recursive listing still enters.
DEPTH = 6
SEPARATOR = "/"


def parts_of(path: Column) -> Column:
    """The names of a path, without those that doubled or outer separators leave empty."""
    return F.filter(F.split(F.translate(path, "\\", SEPARATOR), SEPARATOR), lambda x: x != "")


def ancestors(parts: Column) -> Column:
    """Every beginning of the names as a path, the whole one included."""
    return F.transform(parts, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), SEPARATOR))


def folders_of(paths: DataFrame, path: str, files: bool = False) -> DataFrame:
    """folder: every folder on the way to the paths, each once; the paths themselves only where they are no ``files``."""
    parts = parts_of(F.col(path))
    own = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))) if files else parts
    return paths.where(F.col(path).isNotNull()).select(F.explode(ancestors(own)).alias("folder")).distinct()


def scan_jobs(roots: DataFrame, files: DataFrame) -> DataFrame:
    """root_path, library, path, files: a job for each first-level folder of each enabled root.

    roots (path, enabled), files (root_path, rel_path). A root that is off or holds no files has no jobs; files
    that lie in the root itself belong to none. Empty folders do not show in a listing of files. Null paths and
    null marks count as missing and off; a root that is named twice counts once.
    """
    on = roots.where(F.col("enabled") & F.col("path").isNotNull()).select(F.col("path").alias("root_path")).distinct()
    parts = parts_of(F.col("rel_path"))
    first = files.where(F.size(parts) > 1).select("root_path", F.get(parts, F.lit(0)).alias("library"))
    sums = first.groupBy("root_path", "library").agg(F.count("*").alias("files"))
    return sums.join(on, "root_path", "left_semi").select("root_path", "library", F.concat_ws(SEPARATOR, "root_path", "library").alias("path"), "files")


def directory_listing(files: DataFrame, path: str, size: str, folder: str = "", pattern: str = "", recursive: bool = False, depth: int = DEPTH, most: int = 200) -> DataFrame:
    """kind, name, size_bytes, matched: the folders by name, then the files, larger ones first, of one folder.

    With ``recursive`` also what lies below, through ``depth`` folders at most, each with its path from the folder.
    A pattern is compared with the last name, whatever its case. At most ``most`` folders and ``most`` files are
    listed; ``matched`` says how many there are. Files of equal size come by name; a file listed twice counts twice.
    """
    base = [x for x in folder.replace("\\", SEPARATOR).split(SEPARATOR) if x]
    parts = parts_of(F.col(path))
    below = files.select(parts.alias("p"), F.col(size).cast("long").alias("size_bytes")).where(F.size("p") > len(base))
    for i, name in enumerate(base):
        below = below.where(F.lower(F.get("p", F.lit(i))) == name.lower())
    below = below.select(F.slice("p", F.lit(len(base) + 1), F.size("p")).alias("p"), "size_bytes")
    levels = depth + 1 if recursive else 1
    fits = lambda c: glob_match(c, pattern) if pattern else F.lit(True)
    leaf = lambda c: F.element_at(F.split(c, SEPARATOR), -1)
    found = below.where((F.size("p") <= levels) & fits(F.element_at("p", -1))).select(F.lit("file").alias("kind"), F.array_join("p", SEPARATOR).alias("name"), "size_bytes")
    way = F.slice("p", F.lit(1), F.least(F.size("p") - 1, F.lit(levels)))
    dirs = below.where(F.size("p") > 1).select(F.explode(ancestors(way)).alias("name")).distinct().where(fits(leaf(F.col("name")))).select(F.lit("folder").alias("kind"), "name", F.lit(0).cast("long").alias("size_bytes"))
    shown = lambda rows, *order: rows.orderBy(*order).limit(most).crossJoin(rows.agg(F.count("*").alias("matched")))  # noqa: E731  one row
    listed = shown(dirs, "name").union(shown(found, F.desc("size_bytes"), "name"))
    return listed.orderBy(F.desc("kind"), F.desc("size_bytes"), "name")
