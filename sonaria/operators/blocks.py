"""A kept inverted index in blocks with score bounds: a question reads the blocks of its tokens that can matter."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaria.operators.text import K1, B, tokens_of
from sonaria.sources.shared import delete_path, new_path, written

#: Postings of a block at most; documents of a segment of keys about, and segments at most.
BLOCK, SEGMENT_DOCS, SEGMENTS = 128, 4096, 4096
#: Folders of the index, each with the tokens of a share of all hashes.
BUCKETS = 64
#: Postings that a task holds before it passes them on, about.
HELD = 50_000
#: Sums of the same parts in another order may differ by this share.
SLACK = 1e-9

_BLOCK = "bucket int, token string, segment int, best double, n int, keys array<long>, tfs array<int>, lens array<int>"


@dataclass
class Index:
    """Where an index lies, and what the scores need of all documents."""

    path: str
    documents: int
    mean_length: float
    segments: int


def bucket(token):
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def weight(tf, length, mean):
    """The part of a score that a token's frequency makes, without the token's rarity."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def counted(batches: Iterator[pa.RecordBatch], cut: Callable[[str | None], list[str]]) -> Iterator[pa.RecordBatch]:
    """key, token, tf, len of (key, text), passed on after ``HELD`` postings whatever a batch holds."""
    keys, tokens, tfs, lens = [], [], [], []

    def passed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(tokens, pa.string()), pa.array(tfs, pa.int32()), pa.array(lens, pa.int32())], ["key", "token", "tf", "len"])

    for batch in batches:
        for k, t in zip(batch.column(0), batch.column(1)):
            words = cut(t.as_py())
            found = Counter(words)
            keys += [k.as_py()] * max(1, len(found))  # a text without tokens counts as a document too
            tokens += list(found) or [None]
            tfs += list(found.values()) or [0]
            lens += [len(words)] * max(1, len(found))
            if len(keys) >= HELD:
                yield passed()
                keys, tokens, tfs, lens = [], [], [], []
    yield passed()


def _blocked(cuts: np.ndarray, mean: float):
    """Sorted postings to blocks: a new one where the token or the segment changes, or after ``BLOCK``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tokens, key = batch.column("token"), batch.column("key").to_numpy()
            tf, length = batch.column("tf").to_numpy(), batch.column("len").to_numpy()
            segment = np.searchsorted(cuts, key, "right").astype(np.int32)
            codes = tokens.dictionary_encode().indices.to_numpy()
            new = np.append(True, (codes[1:] != codes[:-1]) | (segment[1:] != segment[:-1]))
            run_start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            starts = np.flatnonzero((np.arange(n) - run_start) % BLOCK == 0)
            best = np.maximum.reduceat(weight(tf, length, mean), starts)
            offsets = pa.array(np.append(starts, n).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((key, pa.int64()), (tf, pa.int32()), (length, pa.int32()))]
            at = pa.array(starts)
            heads = [batch.column("bucket").take(at), tokens.take(at), pa.array(segment[starts]), pa.array(best), pa.array(np.diff(np.append(starts, n)).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(heads + lists, [c.split()[0] for c in _BLOCK.split(", ")])

    return run


def build(docs: DataFrame, key: str, text: str, cut: Callable[[str | None], list[str]] = tokens_of, path: str | None = None) -> Index:
    """Write the index of ``docs`` to ``path``, a new folder that all executors share.

    ``key`` is a whole number and tells documents apart; rows without one are left out, a text that is null
    has no tokens. Texts are cut once. Their postings are sorted in ranges of (bucket, token, key), so a token
    that a third of all documents hold lies in several ranges. A block holds postings of one token and one
    segment of keys, and the greatest weight among them. A folder that holds an index is an error.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "block-index")
    known = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key is not null")
    flat = written(known.mapInArrow(lambda batches: counted(batches, cut), "key long, token string, tf int, len int"), "counted")
    whole = flat.groupBy("key").agg(F.max("len").alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
    segments = max(1, min(SEGMENTS, whole["n"] // SEGMENT_DOCS + 1))
    cuts = known.approxQuantile("key", [i / segments for i in range(1, segments)], 0.25 / segments) if segments > 1 else []
    mean = float(whole["mean"] or 1.0)
    ordered = flat.where("token is not null").withColumn("bucket", bucket("token"))
    ordered = ordered.repartitionByRange("bucket", "token", "key").sortWithinPartitions("bucket", "token", "key")
    ordered.mapInArrow(_blocked(np.unique(cuts), mean), _BLOCK).write.partitionBy("bucket").parquet(path + "/blocks")
    delete_path(spark, flat.inputFiles()[0].rsplit("/", 1)[0])
    made = Index(path, int(whole["n"]), mean, segments)
    spark.createDataFrame([(json.dumps(asdict(made)),)], "value string").coalesce(1).write.text(path + "/about")
    return made


def load(spark: SparkSession, path: str) -> Index:
    """The index at ``path``; one that was not written to its end has no ``about`` and is an error."""
    return Index(**json.loads(spark.read.text(path + "/about").first()["value"]) | {"path": path})


def _blocks(spark: SparkSession, index: Index, words: list[str]) -> DataFrame:
    """The blocks of some tokens: only their folders and, by the files' statistics, their part of them are read."""
    names = spark.createDataFrame([(w,) for w in words], "token string").select("token", bucket("token").alias("b")).collect()
    rows = spark.read.schema(_BLOCK).parquet(index.path + "/blocks")
    return rows.where(F.col("bucket").isin(sorted({r["b"] for r in names})) & F.col("token").isin(words))


def _scores(blocks: DataFrame, idf: dict[str, float], mean: float) -> DataFrame:
    rarity = F.create_map(*[F.lit(x) for pair in idf.items() for x in pair])
    each = blocks.select("token", F.explode(F.arrays_zip("keys", "tfs", "lens")).alias("p"))
    return each.select(F.col("p.keys").alias("key"), (rarity[F.col("token")] * weight(F.col("p.tfs").cast("double"), F.col("p.lens"), F.lit(mean))).alias("s")).groupBy("key").agg(F.sum("s").alias("score"))


@dataclass
class Answer:
    """key, score of the best; and of the blocks of the question's tokens, how many there are and how many were read."""

    rows: DataFrame
    blocks: int
    read: int


def search(spark: SparkSession, index: Index, query: list[str], k: int) -> Answer:
    """The ``k`` documents of highest BM25 score for the distinct tokens of ``query``, equal scores by key.

    First the blocks' heads are read, without their postings: they give each token's documents and, by
    segment, the most that a document there can score. Segments of the greatest such sums are scored until
    ``k`` documents are found; the last one's score is a floor. Then only those blocks are read whose own
    greatest part and the other tokens' greatest parts in the segment together reach the floor. A document
    that reaches it keeps all its blocks, and one that does not can only lose, so the answer is that of a
    full scan. Heads come to the driver as one number a token and segment, ``SEGMENTS`` a token at most.
    """
    words = sorted(set(query))
    empty = spark.createDataFrame([], "key long, score double")
    if not words or not index.documents or k <= 0:
        return Answer(empty, 0, 0)
    blocks = _blocks(spark, index, words)
    heads = blocks.groupBy("token", "segment").agg(F.max("best").alias("best"), F.sum("n").alias("n"), F.count("*").alias("blocks")).toPandas()
    if heads.empty:
        return Answer(empty, 0, 0)
    df = heads.groupby("token")["n"].sum()
    idf = {t: float(np.log(1 + (index.documents - n + 0.5) / (n + 0.5))) for t, n in df.items()}
    heads["most"] = heads["best"] * heads["token"].map(idf)
    reach = heads.groupby("segment")["most"].sum().sort_values(ascending=False, kind="stable")
    floor, tried = 0.0, 1
    while True:
        some = blocks.where(F.col("segment").isin([int(s) for s in reach.index[:tried]]))
        found = [r["score"] for r in _scores(some, idf, index.mean_length).orderBy(F.desc("score")).limit(k).collect()]
        if len(found) == k:
            floor = found[-1] * (1 - SLACK)
        if len(found) == k or tried >= len(reach):
            break
        tried *= 8
    heads["least"] = (floor - (heads["segment"].map(reach) - heads["most"])) / heads["token"].map(idf)
    keep = heads[heads["best"] >= heads["least"] * (1 - SLACK) - SLACK]
    limits = spark.createDataFrame([(t, int(s), float(x)) for t, s, x in zip(keep["token"], keep["segment"], keep["least"])], "token string, segment int, least double")
    inside = blocks.where(F.col("segment").isin(sorted({int(s) for s in keep["segment"]})))
    kept = inside.join(F.broadcast(limits), ["token", "segment"]).where(F.col("best") >= F.col("least") * (1 - SLACK) - SLACK)  # a row a token and segment
    rows = _scores(kept, idf, index.mean_length).where("score > 0").orderBy(F.desc("score"), "key").limit(k)
    return Answer(rows, int(heads["blocks"].sum()), kept.count())
