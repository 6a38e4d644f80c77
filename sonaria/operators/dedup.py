"""Duplicate files by size and digest, and libraries that share instrument names."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaria.functions.scalars import version_key
from sonaria.operators.relational import similar_pairs

# Which pairs count and how depends on them.
JACCARD_MIN, IDENTICAL, COVER, SIZE_TOLERANCE = 0.35, 0.95, 0.97, 0.05
MIN_FILE_BYTES = 5 << 20
#: The bytes of a file that its digest is made of.
HEAD, TAIL = 4 << 20, 1 << 20


def _candidates(files: DataFrame, least: int) -> DataFrame:
    """Files of ``least`` bytes or more of a size that files of two libraries have."""
    big = files.where(F.col("size_bytes") >= least)
    sizes = big.groupBy("size_bytes").agg(F.min("library").alias("x"), F.max("library").alias("y")).where("x < y")
    return big.join(sizes.select("size_bytes"), "size_bytes", "left_semi")


def _groups(digests: DataFrame) -> DataFrame:
    """Only digests are shuffled, and counted before that."""
    per = digests.groupBy("fp", "size_bytes", "library").agg(F.count("*").alias("n"))
    groups = per.groupBy("fp", "size_bytes").agg(F.sum("n").alias("files"), F.count("library").alias("libraries"))
    groups = groups.where("files >= 2 and libraries >= 2").withColumn("reclaimable", F.col("size_bytes") * (F.col("files") - 1))
    return groups.orderBy(F.desc("reclaimable"), "fp")


def duplicate_files(files: DataFrame, content: str = "text", least: int = MIN_FILE_BYTES) -> DataFrame:
    """fp, size_bytes, files, libraries, reclaimable: equal files in two libraries or more, from a table
    with their content. A digest is made of the first ``HEAD`` bytes, and of the last ``TAIL`` of longer ones,
    and only of files whose size occurs in two libraries."""
    data = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    n = F.octet_length(content)
    ends = F.when(n > HEAD + TAIL, F.concat(F.substring(data, 1, HEAD), F.substring(data, -TAIL, TAIL))).otherwise(F.substring(data, 1, HEAD))
    return _groups(_candidates(files, least).select(F.sha2(ends, 256).alias("fp"), "size_bytes", "library"))


def file_digests(files: DataFrame, head: int = HEAD, tail: int = TAIL) -> DataFrame:
    """path, library, size_bytes, fp, bytes_read: digests of the ends of files in a store; none of a file
    that cannot be read. Files are dealt out by path, so that few large ones do not meet in one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            out = []
            for path in frame["path"]:
                digest, read = hashlib.sha256(), 0
                try:
                    store, name = fs.FileSystem.from_uri(path)
                    with store.open_input_file(name) as file:
                        parts = [(0, head)] + ([(file.size() - tail, tail)] if file.size() > head + tail else [])
                        for at, n in parts:
                            file.seek(at)
                            digest.update(data := file.read(n))
                            read += len(data)
                    out.append((digest.hexdigest(), read))
                except (OSError, ValueError):
                    out.append((None, read))
            yield frame.assign(fp=[x for x, _ in out], bytes_read=[n for _, n in out])

    rows = files.select("path", "library", "size_bytes").repartition("path")
    return rows.mapInPandas(run, "path string, library string, size_bytes long, fp string, bytes_read long")


def duplicate_stored_files(files: DataFrame, least: int = MIN_FILE_BYTES, head: int = HEAD, tail: int = TAIL) -> DataFrame:
    """The same of files in a store, listed as (path, library, size_bytes): two phases, sizes first."""
    return _groups(file_digests(_candidates(files, least), head, tail).where("fp is not null"))


def library_similarity(names: DataFrame, least: float = JACCARD_MIN) -> DataFrame:
    """a, b, shared, ka, kb, jaccard, cover_a, cover_b of pairs at ``least`` or more."""
    own = names.select("library_id", F.lower("name").alias("name"))
    pairs = similar_pairs(own, "library_id", "name", least - 0.0005)  # the measures are rounded to three digits
    shared = F.col("shared")
    made = pairs.withColumn("jaccard", F.bround(shared / (F.col("ka") + F.col("kb") - shared), 3)).withColumn("cover_a", F.bround(shared / F.col("ka"), 3)).withColumn("cover_b", F.bround(shared / F.col("kb"), 3))
    return made.where(F.col("jaccard") >= least)


def classify_relations(pairs: DataFrame, libraries: DataFrame) -> DataFrame:
    """Adds relation (identical, superset, upgrade) and the library to keep: the registered one,
    else the newer, else the larger, else the first."""
    side = lambda s: libraries.select(*[F.col(c).alias(f"{c}_{s}" if c != "id" else s) for c in ("id", "size_bytes", "version", "registered")])
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    close = F.abs(F.col("size_bytes_a") - F.col("size_bytes_b")) <= SIZE_TOLERANCE * F.greatest("size_bytes_a", "size_bytes_b")
    relation = F.when((F.col("jaccard") >= IDENTICAL) & close, "identical").when((F.greatest("cover_a", "cover_b") >= COVER) & (F.col("ka") != F.col("kb")), "superset").otherwise("upgrade")
    va, vb = version_key(F.col("version_a")), version_key(F.col("version_b"))
    keep = (
        F.when(F.col("registered_a") & ~F.col("registered_b"), F.col("a"))
        .when(F.col("registered_b") & ~F.col("registered_a"), F.col("b"))
        .when(va > vb, F.col("a"))
        .when(vb > va, F.col("b"))
        .when(F.col("size_bytes_b") > F.col("size_bytes_a"), F.col("b"))
        .otherwise(F.col("a"))
    )
    return rows.withColumn("relation", relation).withColumn("keep", keep)
