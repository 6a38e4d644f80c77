"""Files as DataFrames: listings of roots, headers, markup, settings, audio."""

from __future__ import annotations

import io
import re
import wave
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaria.functions.scalars import looks_like_manual, version_key
from sonaria.operators.relational import first_rows

# Which files count as what.
JUNK = ["torrent", "url", "rar", "zip", "7z", "exe", "dmg", "iso", "nfo"]
MANUAL = ["pdf", "rtf", "chm", "epub", "docx", "txt", "html", "htm"]
AUDIO = ["wav", "aif", "aiff", "ogg", "mp3", "flac", "nksn", "ncw", "nkx"]
KEEP_NAMES = ["logic_icons.zip", "delaycomp-win64-1.2.0.zip"]
MIN_SAMPLE_BYTES, CLIP_CAP, ENCODED_CAP, MANUAL_CAP = 8 * 1024, 160, 240, 40


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """root, library, rel_path, name, ext, size_bytes, mtime of all files below a root; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = re.sub(r"^file:/*", "/", root).rstrip("/")
    path = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
    rel = F.substring(path, F.lit(len(base) + 2), F.lit(1 << 20))
    name = F.element_at(F.split(rel, "/"), -1)
    ext = F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")
    return files.select(F.lit(base).alias("root"), F.split_part(rel, F.lit("/"), F.lit(1)).alias("library"), rel.alias("rel_path"), name.alias("name"), ext.alias("ext"), F.col("length").alias("size_bytes"), F.unix_timestamp("modificationTime").alias("mtime"))


def library_sums(files: DataFrame) -> DataFrame:
    kinds = [F.count_if(F.col("ext") == k).alias(f"{k}_count") for k in ("nki", "nkm", "nkc")]
    return files.groupBy("root", "library").agg(F.count("*").alias("file_count"), F.sum("size_bytes").alias("size_bytes"), *kinds, F.bool_or(F.col("ext") == "nicnt").alias("has_nicnt"))


def junk(files: DataFrame) -> DataFrame:
    return files.where(F.col("ext").isin(*JUNK)).withColumn("suggested_keep", F.lower("name").isin(*KEEP_NAMES))


def manuals(files: DataFrame, cap: int = MANUAL_CAP) -> DataFrame:
    return first_rows(files.where(F.col("ext").isin(*MANUAL) & looks_like_manual(F.col("name"), F.col("size_bytes"))), ["root", "library"], "rel_path", cap)


def clips(files: DataFrame) -> DataFrame:
    """Audio files with their kind; small samples are left out, and each library's numbers are capped:
    160 clips of ordinary kinds, counting all before them, and 240 of encoded ones."""
    kind = F.when(F.col("ext").isin("ncw", "nkx"), F.col("ext")).when(F.lower("rel_path").rlike("demo|preview") | (F.col("ext") == "nksn"), "demo").otherwise("sample")
    rows = files.where(F.col("ext").isin(*AUDIO)).withColumn("kind", kind).where((F.col("kind") != "sample") | (F.col("size_bytes") > MIN_SAMPLE_BYTES))
    coded = F.col("kind").isin("ncw", "nkx")
    # an ordinary clip counts all before it, so those within the cap are among the first of all
    keys = ["root", "library"]
    return first_rows(rows, keys, "rel_path", CLIP_CAP).where(~coded).unionByName(first_rows(rows.where(coded), keys, "rel_path", ENCODED_CAP))


def newest_versions(instruments: DataFrame, key: str = "library", version: str = "engine_version") -> DataFrame:
    return instruments.groupBy(key).agg(F.max_by(version, version_key(F.col(version))).alias(version))


_VERSION = re.compile(r"\b\d{1,2}\.\d{1,2}\.\d{1,2}(?:\.\d{1,4})?\b")
_NAME = re.compile(rb"(?:[\x20-\x7e]\x00){4,64}")


def _header(data: bytes) -> tuple[str, str, str]:
    head = data[: 64 << 10]
    form = "container" if head[12:16] == b"hsin" else "legacy"
    texts = [m.group().decode("utf-16-le") for m in _NAME.finditer(head)]
    name = next((t.strip() for t in texts if re.search(r"[A-Za-z]{3}", t) and not _VERSION.search(t)), "")
    version = next((m.group() for t in texts if (m := _VERSION.search(t))), "")
    return form, name, version


def read_header(content: Column | str) -> Column:
    """Format, first plausible name and first version in an instrument file's first 64 KiB."""

    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_header(bytes(c or b"")) for c in values], columns=["form", "name", "version"])

    return F.pandas_udf(run, "form string, name string, version string")(content)


def _text_of(markup: str | None) -> str:
    s = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", markup or "")
    s = re.sub(r"(?s)<[^>]*>", " ", s)
    s = re.sub(r"\\'[0-9a-f]{2}|\\[a-z]+-?\d* ?|[{}]", " ", s) if s.startswith("{\\rtf") else s
    return " ".join(unescape(s).split())


def plain_text(markup: Column | str) -> Column:
    """Text of HTML or RTF without markup, references decoded, white space squeezed."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(_text_of)

    return F.pandas_udf(run, "string")(markup)


def product_fields(xml: Column) -> list[Column]:
    """Name, key and version of a product's XML block."""
    return [F.xpath_string(xml, F.lit(f"//{tag}")).alias(alias) for tag, alias in (("Name", "name"), ("RegKey", "reg_key"), ("Version", "version"))]


def hints(xml: Column) -> Column:
    """The repeated elements of a hints file as an array."""
    return F.from_xml(xml, "Library array<struct<Name string, RegKey string, Path string, Version string>>")["Library"]


def ini_sections(text: Column) -> Column:
    """section and ContentDir of the sections of a settings file that have one."""
    sections = F.regexp_extract_all(text, F.lit(r"(?s)(\[[^\]]+\][^\[]*)"), F.lit(1))
    read = F.transform(sections, lambda s: F.struct(F.regexp_extract(s, r"^\[([^\]]+)\]", 1).alias("section"), F.regexp_extract(s, r"(?m)^ContentDir=(?:sz:)?(.*?)\s*$", 1).alias("content_dir")))
    return F.filter(read, lambda r: r["content_dir"] != "")


AUDIO_SCHEMA = "path string, rate int, seconds double, features array<double>, error string"
#: Samples that a task holds as results before it passes them on, and files at most.
HELD_SAMPLES, HELD_FILES = 1 << 19, 256
_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def clip_batches(batches: Iterator[pa.RecordBatch], seconds: float, schema: str, made: Callable[[int, np.ndarray], tuple]) -> Iterator[pa.RecordBatch]:
    """path, the columns that ``made`` gives of a file's rate and samples, and an error per file (path, content).

    What a task holds does not grow with an Arrow batch: results go on after ``HELD_SAMPLES`` samples."""
    fields = [c.split() for c in schema.split(", ")]
    out: list[tuple] = []
    held = 0

    def passed() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])

    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            try:
                rate, x = decode_wave(content.as_py() or b"", seconds)
                row = made(rate, x)
                held += sum(c.size for c in row if isinstance(c, np.ndarray))
                out.append((path.as_py(), *row, None))
            except (ValueError, EOFError, wave.Error) as e:
                out.append((path.as_py(), *[None] * (len(fields) - 2), str(e)))
            if held >= HELD_SAMPLES or len(out) >= HELD_FILES:
                yield passed()
                out, held = [], 0
    yield passed()


def _each_clip(files: DataFrame, seconds: float, schema: str, made: Callable[[int, np.ndarray], tuple]) -> DataFrame:
    return files.select("path", "content").mapInArrow(lambda batches: clip_batches(batches, seconds, schema, made), schema)


def audio_features(files: DataFrame, seconds: float = 12.0) -> DataFrame:
    """path, rate, seconds, the 32 features and an error per audio file."""
    return _each_clip(files, seconds, AUDIO_SCHEMA, lambda rate, x: (rate, len(x) / rate, acoustic_features(x, rate)))


def audio_samples(files: DataFrame, seconds: float = 12.0, to: int | None = None) -> DataFrame:
    """path, rate, samples (mono, -1..1, resampled to the rate ``to`` if it is given) and an error per file."""
    return _each_clip(files, seconds, "path string, rate int, samples array<double>, error string", lambda rate, x: (to or rate, resample(x, rate, to) if to else x))


def decode_wave(data: bytes, seconds: float) -> tuple[int, np.ndarray]:
    """The rate and the first seconds of a PCM file as mono samples in -1..1."""
    with wave.open(io.BytesIO(data)) as w:
        rate, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
        raw = w.readframes(int(seconds * rate))
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(float) / (1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(float) / float(1 << (8 * width - 1))
    return rate, x.reshape(-1, channels).mean(axis=1)


def resample(x: np.ndarray, rate: int, to: int = 16_000) -> np.ndarray:
    n = int(len(x) * to / rate)
    return np.interp(np.arange(n) * rate / to, np.arange(len(x)), x)


def attack_time(x: np.ndarray, rate: int) -> float:
    """Seconds from 2 % to 90 % of the loudest 10 ms, one at most."""
    step = max(1, rate // 100)
    env = np.sqrt((x[: len(x) // step * step].reshape(-1, step) ** 2).mean(axis=1)) if len(x) >= step else np.abs(x)
    peak = env.max() if len(env) else 0.0
    if peak <= 0:
        return 0.0
    start, end = int(np.argmax(env >= 0.02 * peak)), int(np.argmax(env >= 0.9 * peak))
    return float(min(1.0, max(0, end - start) * step / rate))


def acoustic_features(x: np.ndarray, rate: int) -> np.ndarray:
    """13 cepstral means and 13 deviations, centroid, rolloff, flatness, crest, loudness and attack,
    each squashed by tanh(x/10); at least a tenth of a second is needed."""
    loud = np.flatnonzero(np.abs(x) > 0.02 * (np.abs(x).max() if len(x) else 0))
    x = x[loud[0] :] if len(loud) else x
    if len(x) < rate // 10:
        raise ValueError("too short")
    size, hop = 1024, 512
    x = np.pad(x, (0, max(0, size - len(x))))
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop] * np.hanning(size)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2 + 1e-12
    freq = np.fft.rfftfreq(size, 1 / rate)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), 28) / 2595) - 1)
    bank = np.stack([np.clip(np.minimum((freq - a) / (b - a), (c - freq) / (c - b)), 0, None) for a, b, c in zip(edges, edges[1:], edges[2:])])
    logs = np.log(power @ bank.T + 1e-10)
    dct = np.cos(np.pi / 26 * (np.arange(26) + 0.5)[None] * np.arange(13)[:, None])
    mfcc = logs @ dct.T / 13
    share = power / power.sum(axis=1, keepdims=True)
    centroid = float((share @ freq).mean() / (rate / 2))
    rolloff = float(freq[(np.cumsum(share, axis=1) < 0.85).sum(axis=1).clip(max=len(freq) - 1)].mean() / (rate / 2))
    flat = float((np.exp(np.log(power).mean(axis=1)) / power.mean(axis=1)).mean())
    rms = float(np.sqrt((x**2).mean()))
    crest = float(np.abs(x).max() / rms) if rms else 0.0
    deviation = mfcc.std(axis=0, ddof=1) if len(mfcc) > 1 else np.zeros(13)
    raw = np.concatenate([mfcc.mean(axis=0), deviation, [centroid, rolloff, flat, crest, rms, attack_time(x, rate)]])
    return np.tanh(np.nan_to_num(raw, nan=0.0, posinf=0.0, neginf=0.0) / 10)
