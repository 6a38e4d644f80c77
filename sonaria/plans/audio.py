"""Files' own bytes as queries: audio, instrument headers, CSV and knowledge documents.

The given tables hold no files, so each query makes the bytes of one file a row and reads them back.
"""

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from sonaria.plans.registry import query
from sonaria.sources import files, tables
from sonaria.sources.shared import new_path

RATE, SAMPLES = 8000, 2400


def _wave(v) -> bytes:
    """A PCM file whose samples hold the values of a vector, one after the other."""
    v = np.asarray(v, float)
    x = v[np.arange(SAMPLES) * len(v) // SAMPLES] / max(np.abs(v).max(), 1e-9)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes((x * 32000).astype("<i2").tobytes())
    return out.getvalue()


def _clips(c):
    """path, content: a clip of each embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, files.HELD_FILES):
                part = batch.slice(at, files.HELD_FILES)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_wave(v.as_py()) for v in part.column(1)], pa.binary())], ["path", "content"])

    return c.table("embeddings").select(F.col("vec_id").cast("string"), "embedding").mapInArrow(run, "path string, content binary")


@query("audio_decode", "", f"SELECT vec_id, {RATE} AS rate, {SAMPLES} AS n, 0.976563 AS peak FROM embeddings")
def audio_decode(c):
    """The rate, the number of samples and the peak level of every clip."""
    rows = files.audio_samples(_clips(c))
    peak = F.array_max(F.transform("samples", lambda x: F.abs(x)))
    return rows.select(F.col("path").cast("long").alias("vec_id"), "rate", F.size("samples").alias("n"), F.round(peak, 6).alias("peak"))


@query("resample_linear", "", f"SELECT vec_id, {SAMPLES * 2} AS n FROM embeddings")
def resample_linear(c):
    rows = files.audio_samples(_clips(c), to=2 * RATE)
    return rows.select(F.col("path").cast("long").alias("vec_id"), F.size("samples").alias("n"))


@query("acoustic_features_32")
def acoustic_features(c):
    rows = files.audio_features(_clips(c))
    return rows.select(F.col("path").cast("long").alias("vec_id"), "rate", F.transform("features", lambda x: F.round(x, 5)).alias("features"), "error")


@query("attack_time")
def attack_time(c):
    """Seconds of the attack, which the last of the 32 features holds squashed."""
    rows = files.audio_features(_clips(c)).select(F.col("path").cast("long").alias("vec_id"), F.get("features", F.lit(31)).alias("x"))
    return rows.select("vec_id", F.round(10 * 0.5 * F.log((1 + F.col("x")) / (1 - F.col("x"))), 4).alias("seconds"))


@query("nki_header_read", "instruments", "SELECT id, CASE WHEN kind = 'nki' THEN 'container' ELSE 'legacy' END AS form, name, '5.' || (id % 9) || '.1' AS version FROM instruments")
def nki_header_read(c):
    """Format, name and version of every instrument from its first bytes."""

    def run(names: pd.Series, kinds: pd.Series, ids: pd.Series) -> pd.Series:
        mark = {"nki": b"hsin"}
        return pd.Series([bytes(12) + mark.get(k, b"none") + bytes(6) + f"{n}".encode("utf-16-le") + bytes(4) + f"5.{i % 9}.1".encode("utf-16-le") + bytes(64) for n, k, i in zip(names, kinds, ids)])

    content = F.pandas_udf(run, "binary")("name", "kind", "id")
    return c("instruments").select("id", files.read_header(content).alias("h")).select("id", "h.form", "h.name", "h.version")


@query("golden_csv_read", "libraries", """SELECT CAST(id AS VARCHAR) AS id, 'a "' || name || '", ' || path AS said, category FROM libraries""")
def golden_csv_read(c):
    """Fields with quotes and commas, written and read again."""
    path = new_path(c.spark, "csv")
    said = F.concat(F.lit('a "'), "name", F.lit('", '), "path")
    tables.write_csv(c("libraries").select("id", said.alias("said"), "category"), path)
    return tables.read_csv(c.spark, path)


@query("export_libraries_csv", "libraries manuals junk", """SELECT l.name, l.category, CAST(l.size_bytes AS VARCHAR) AS size_bytes, CAST(coalesce((SELECT count(*) FROM manuals m WHERE m.library_id = l.id), 0) AS VARCHAR) AS manuals, CAST(coalesce((SELECT count(*) FROM junk j WHERE j.library_id = l.id), 0) AS VARCHAR) AS junk FROM libraries l""")
def export_libraries_csv(c):
    """The export as a CSV file, read back as text."""
    from sonaria.plans.rollups import export_libraries

    path = new_path(c.spark, "export")
    tables.write_csv(export_libraries(c), path)
    return tables.read_csv(c.spark, path)


@query("kb_json_load_save", "", "SELECT doc_id AS library_id, len(string_split(text, chr(10))) AS page_count, CAST(sum(length(line)) AS BIGINT) AS chars FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id, text")
def kb_json_load_save(c):
    """Every document as a nested knowledge document, a line of text a page, saved and loaded again."""
    pages = F.transform(F.split("text", "\n", -1), lambda t, i: F.struct((i + 1).alias("n"), t.alias("text"), F.lit("text").alias("source")))
    rows = c.table("documents").select(F.col("doc_id").alias("library_id"), F.col("source").alias("manual_name"), pages.alias("pages"))
    rows = rows.select("library_id", "manual_name", F.size("pages").alias("page_count"), "pages", F.transform("pages", lambda p: F.struct((p["n"] - 1).alias("id"), p["n"].alias("page"), p["text"])).alias("chunks"))
    path = new_path(c.spark, "kb")
    tables.write_kb(rows, path)
    made = tables.read_kb(c.spark, path)
    chars = F.aggregate("pages", F.lit(0).cast("long"), lambda n, p: n + F.char_length(p["text"]))
    return made.select("library_id", "page_count", chars.alias("chars"))
