"""Catalog tables on disk: schemas, snapshots, upserts and exports."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonaria.operators.relational import newest, upsert

SCHEMAS: dict[str, str] = {
    "roots": "id long, path string, label string, enabled boolean, added_at string, last_scanned_at string",
    "libraries": "id long, root_id long, name string, path string, category string, size_bytes long, file_count int, nki_count int, nkm_count int, nkc_count int, has_nicnt boolean, junk_count int, junk_bytes long, product_key string, required_version string, cover_file string, notes string, last_scanned_at string",
    "manuals": "id long, library_id long, rel_path string, name string, ext string, size_bytes long, is_primary boolean",
    "instruments": "id long, library_id long, rel_path string, name string, kind string, size_bytes long, mtime long, name_source string, file_format string, engine_version string, articulation string",
    "favorites": "instrument_id long, created_at string",
    "tags": "id long, name string",
    "tag_map": "entity_type string, entity_id long, tag_id long",
    "agent_trace": "id long, session_id long, step int, tool_name string, args_hash string, args_preview string, ok boolean, elapsed_ms long, result_chars int, error string, created_at string, prompt_tokens int, completion_tokens int, reasoning_tokens int",
    "audio_clips": "id long, library_id long, rel_path string, name string, ext string, size_bytes long, kind string",
    "audio_features": "clip_id long, library_id long, dim int, vec array<float>, created_at string",
    "map_points": "clip_id long, library_id long, x double, y double, cluster int",
    "junk_files": "id long, library_id long, rel_path string, kind string, size_bytes long, suggested_keep boolean",
    "scan_runs": "id long, started_at string, finished_at string, mode string, roots_count int, libraries_found int, files_indexed int, errors int, elapsed_seconds double",
    "memory": "id long, scope string, library_id long, key string, content string, importance int, created_at long, updated_at long",
}
KB_SCHEMA = "library_id long, manual_name string, page_count int, pages array<struct<n:int,text:string,source:string>>, chunks array<struct<id:int,page:int,text:string>>"


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def read_kb(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Nested knowledge documents, one a line as ``write_kb`` saves them, or one a file."""
    return spark.read.schema(KB_SCHEMA).json(path, multiLine=whole_files)


def write_kb(docs: DataFrame, path: str) -> None:
    """Save knowledge documents in the columns of KB_SCHEMA, one a line."""
    names = [f.name for f in T.StructType.fromDDL(KB_SCHEMA).fields]
    docs.select(*names).write.mode("overwrite").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, quote='"', escape='"')


def write_csv(rows: DataFrame, path: str, mark: bool = False) -> None:
    """Fields are quoted where they hold a comma, a quote or a line end. With ``mark`` every file begins with the mark
    of its encoding, for programs that need it, and empty fields stay empty."""
    options = {"header": True, "quote": '"', "escape": '"'}
    if mark:
        rows = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])
        options["emptyValue"] = ""
    rows.write.mode("overwrite").options(**options).csv(path)


def to_markdown(rows: DataFrame, most: int = 1000) -> str:
    """A table of the first ``most`` rows for people to read."""
    names = rows.columns
    lines = ["| " + " | ".join(names) + " |", "|" + " - |" * len(names)]
    lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows.limit(most).toLocalIterator()]
    return "\n".join(lines)


def unpack_vectors(rows: DataFrame, blob: str, out: str = "vec") -> DataFrame:
    """Little-endian float32 blobs as arrays."""
    @F.pandas_udf("array<float>")
    def read(b: pd.Series) -> pd.Series:
        return b.map(lambda x: np.frombuffer(x, "<f4") if x is not None else None)

    return rows.withColumn(out, read(blob))


def upsert_features(old: DataFrame, new: DataFrame) -> DataFrame:
    """Newest feature row per clip."""
    return newest(old.unionByName(new), ["clip_id"], [F.desc("created_at")])


def replace_children(table: DataFrame, new: DataFrame, library: int) -> tuple[DataFrame, DataFrame]:
    """The table with one library's rows replaced, and (removed, added)."""
    gone = table.where(F.col("library_id") == library)
    counts = gone.agg(F.count("*").alias("removed")).crossJoin(new.agg(F.count("*").alias("added")))  # one row each
    return table.where(F.col("library_id") != library).unionByName(new), counts
