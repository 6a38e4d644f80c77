"""An approximate graph of nearest neighbours by descent.

Lists start from chunks of vectors that lie near one another along random directions; then, round by
round, the neighbours of a point and some of those that name it are compared with one another, for a
neighbour's neighbour is likely one. A round's comparisons of a point are one small matrix product;
what is better than the worst of a list goes to it. Rounds end when few lists change. No group holds
more than a chunk, or twice a list and one; ties of order are dealt by hash, so that many equal
vectors fall into many chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonaria.sources.shared import written

CHUNK = 256
TABLES = 4
ROUNDS = 12
#: Rounds end when fewer than this share of all entries are new.
STILL = 0.002
_LISTS = "id long, nb long, d double"


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances: 1 - cosine (1 to a zero vector), or Euclidean."""
    if metric == "cosine":
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
        return np.maximum(1.0 - unit(a) @ unit(b).T, 0.0)
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0.0))


def _matrix(values: pa.Array) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).astype(np.float64)


def _nearest(ids: np.ndarray, d: np.ndarray, k: int, below: np.ndarray | None = None) -> pa.RecordBatch:
    """The ``k`` nearest of each row of a square matrix, without itself, and nearer than ``below``."""
    d = np.where(ids[:, None] == ids[None, :], np.inf, d)
    k = min(k, len(ids) - 1)
    best = np.argpartition(d, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(ids), 0), np.int64)
    rows = np.repeat(np.arange(len(ids)), best.shape[1])
    columns = best.ravel()
    found = d[rows, columns]
    kept = np.isfinite(found) & (True if below is None else found < below[rows])
    return pa.RecordBatch.from_arrays([pa.array(ids[rows[kept]], pa.int64()), pa.array(ids[columns[kept]], pa.int64()), pa.array(found[kept])], ["id", "nb", "d"])


def _first_lists(rows: DataFrame, k: int, dim: int, metric: str, seed: int) -> DataFrame:
    """Neighbours within chunks of ``CHUNK`` rows along a random direction."""
    direction = np.random.default_rng(seed).standard_normal(dim)
    v = F.col("v").cast("array<double>")
    along = F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in direction]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    if metric == "cosine":
        along = along / F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-30))
    placed = rows.withColumn("along", along).withColumn("tie", F.xxhash64("id", F.lit(seed)))
    parts = max(1, rows.count() // (8 * CHUNK))
    placed = placed.repartitionByRange(parts, "along", "tie").sortWithinPartitions("along", "tie").select("id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                ids, m = part.column(0).to_numpy(), _matrix(part.column(1))
                yield _nearest(ids, distances(m, m, metric), k)

    return placed.mapInArrow(run, _LISTS)


def _best(lists: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each list; a neighbour counts once."""
    once = lists.groupBy("id", "nb").agg(F.min("d").alias("d"), F.min("age").alias("age"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("d", "nb"))
    return once.withColumn("__r", place).where(F.col("__r") <= k).drop("__r")


def vectors_of(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """id, v of the rows that have a vector, in the width they were given: single precision has half the bytes to
    send, and tasks reckon in double."""
    held = F.col(vec) if dict(rows.dtypes)[vec] == "array<float>" else F.col(vec).cast("array<double>")
    return rows.where(F.size(vec) > 0).select(F.col(key).cast("long").alias("id"), held.alias("v"))


def knn_graph(rows: DataFrame, k: int = 15, key: str = "vec_id", vec: str = "embedding", metric: str = "cosine", seed: int = 1) -> DataFrame:
    """id, nb, d: about the ``k`` nearest others of each row; rows without a vector, or of another
    dimension than the most frequent one, have none."""
    sized = vectors_of(rows, key, vec)
    sizes = sized.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return sized.select("id", F.col("id").alias("nb"), F.lit(0.0).alias("d"))
    data = written(sized.where(F.size("v") == sizes["dim"]).dropDuplicates(["id"]), "vectors")
    total = data.count()
    if total < 2:
        return data.select("id", F.col("id").alias("nb"), F.lit(0.0).alias("d")).limit(0)
    k = max(1, min(k, total - 1))
    first = _first_lists(data, k, sizes["dim"], metric, seed)
    for t in range(1, TABLES):
        first = first.union(_first_lists(data, k, sizes["dim"], metric, seed + t))
    lists = written(_best(first.withColumn("age", F.lit(0)), k), "lists")
    own = _member()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column(0):
                held = members.values
                ids, fresh, worst = (held.field(c).to_numpy(zero_copy_only=False) for c in ("u", "fresh", "worst"))
                m = _matrix(held.field("v"))
                d = distances(m, m, metric)
                d[~(fresh[:, None] | fresh[None, :])] = np.inf  # compared in an earlier round
                yield _nearest(ids, d, k, worst)

    for round_ in range(1, ROUNDS + 1):
        worst = lists.groupBy("id").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(float("inf")).alias("worst"))
        fresh = F.col("age") == round_ - 1
        named = lists.select(F.col("nb").alias("c"), F.col("id").alias("u"), fresh.alias("fresh"))
        some = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("fresh"), F.xxhash64("u", F.lit(round_))))
        named = named.withColumn("__r", some).where(F.col("__r") <= k).drop("__r")
        around = lists.select(F.col("id").alias("c"), F.col("nb").alias("u"), fresh.alias("fresh")).union(named).groupBy("c", "u").agg(F.max("fresh").alias("fresh"))
        # without a new member nothing of a point is compared, so no vector is sent to it
        alive = around.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("u", "fresh"))).alias("l")).where(F.exists("l", lambda x: x["fresh"]))  # 2 k at most
        around = alive.select("c", F.explode("l").alias("x")).select("c", "x.u", "x.fresh")
        known = data.withColumnRenamed("id", "u").join(worst.withColumnRenamed("id", "u"), "u", "left").withColumn("worst", F.coalesce("worst", F.lit(float("inf"))))
        held = around.join(known, "u")
        groups = held.groupBy("c").agg(F.sort_array(F.collect_list(own)).alias("members"))  # 2 k at most
        found = groups.select("members").mapInArrow(compared, _LISTS)
        new = written(_best(lists.unionByName(found.withColumn("age", F.lit(round_))), k), "lists")
        lists = new
        if new.where(F.col("age") == round_).count() <= STILL * k * total:
            break
    return lists.select("id", "nb", "d")


def _member() -> Column:
    return F.struct("u", "fresh", "worst", "v")
