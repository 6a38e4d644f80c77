"""A layout of vectors in a plane from the graph of their nearest neighbours (McInnes et al. 2018).

Distances become weights, 1 for the nearest neighbour and falling so that a point's weights sum to the
logarithm of their number; weights of both directions are merged as those of fuzzy sets. The layout
starts from the two main axes. In rounds, points are dealt to parts by hash; a part moves its own points
for some epochs, drawn by neighbours (those of other parts stand still meanwhile) and pushed off by points
of the part, which are a random sample of all. A part has a bounded number of points; parts change with
the round, and only coordinates and edges are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaria.operators.neighbours import knn_graph
from sonaria.operators.vectors import plane
from sonaria.sources.shared import written

#: The curve 1 / (1 + A d^(2 B)) for a least distance of 0.1 and a spread of 1.
A, B = 1.577, 0.895
NEGATIVE = 5
PART_POINTS = 20_000
BATCHES = 4


def fuzzy_edges(graph: DataFrame, k: int) -> DataFrame:
    """id, nb, w in both directions, from the lists of ``knn_graph``."""
    lists = graph.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("d", "nb"))).alias("l"))  # k at most
    target = float(np.log2(max(2, k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            sizes = lists.value_lengths().to_numpy()
            owner = np.repeat(np.arange(len(ids)), sizes)
            flat = lists.flatten()
            d, nb = flat.field("d").to_numpy(), flat.field("nb").to_numpy()
            positive = np.where(d > 0, d, np.inf)
            nearest = np.full(len(ids), np.inf)
            np.minimum.at(nearest, owner, positive)
            nearest[~np.isfinite(nearest)] = 0.0
            beyond = np.maximum(d - nearest[owner], 0.0)
            low, high, sigma = np.zeros(len(ids)), np.full(len(ids), np.inf), np.ones(len(ids))
            for _ in range(48):
                sums = np.bincount(owner, np.exp(-beyond / sigma[owner]), len(ids))
                wide = sums > target
                high, low = np.where(wide, sigma, high), np.where(wide, low, sigma)
                sigma = np.where(np.isinf(high), sigma * 2, (low + high) / 2)
                sigma = np.clip(sigma, 1e-12, 1e12)
            mean = np.bincount(owner, d, len(ids)) / np.maximum(sizes, 1)
            sigma = np.maximum(sigma, 1e-3 * np.where(mean > 0, mean, 1e-9))
            yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(nb), pa.array(np.exp(-beyond / sigma[owner]))], ["id", "nb", "w"])

    one_way = lists.mapInArrow(run, "id long, nb long, w double")
    pair = one_way.groupBy(F.least("id", "nb").alias("a"), F.greatest("id", "nb").alias("b")).agg(F.max("w").alias("m"), F.sum("w").alias("s"))
    merged = pair.select("a", "b", (F.col("s") - F.col("m") * (F.col("s") - F.col("m"))).alias("w"))
    return merged.select(F.col("a").alias("id"), F.col("b").alias("nb"), "w").union(merged.select("b", "a", "w"))


def _moved(points: np.ndarray, own: np.ndarray, other: np.ndarray, fixed: np.ndarray, w: np.ndarray, rate: float, rng: np.random.Generator) -> None:
    """One epoch: each edge takes part as often as its weight says; ``other`` is -1 for a point that stands still."""
    drawn = np.flatnonzero(rng.random(len(w)) < w)
    rng.shuffle(drawn)
    for part in np.array_split(drawn, BATCHES):
        i, j = own[part], other[part]
        there = np.where((j >= 0)[:, None], points[np.maximum(j, 0)], fixed[part])
        apart = points[i] - there
        d2 = (apart**2).sum(1)
        pull = np.where(d2 > 0, -2 * A * B * np.maximum(d2, 1e-12) ** (B - 1) / (1 + A * d2**B), 0.0)
        steps = np.clip(pull[:, None] * apart, -4, 4)
        np.add.at(points, i, rate * steps)
        i = np.repeat(i, NEGATIVE)
        apart = points[i] - points[rng.integers(0, len(points), len(i))]
        d2 = (apart**2).sum(1)
        push = 2 * B / ((0.001 + d2) * (1 + A * d2**B))
        np.add.at(points, i, rate * np.where((d2 > 0)[:, None], np.clip(push[:, None] * apart, -4, 4), 0.0))


def layout(edges: DataFrame, start: DataFrame, epochs: int = 200, rounds: int = 8, part_points: int = PART_POINTS, seed: int = 1) -> DataFrame:
    """id, x, y after ``rounds`` of ``epochs`` in all, from ``start`` (id, x, y) and weighted edges."""
    at = written(start.select("id", "x", "y"), "places")
    parts = max(1, -(-at.count() // part_points))
    rounds = rounds if parts > 1 else 1
    each = -(-epochs // rounds)
    edges = written(edges, "fuzzy-edges")

    def mover(r: int) -> Callable[[pa.Table], pa.Table]:
        def run(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([("id", "ascending"), ("nb", "ascending")])
            ids, first, own = np.unique(rows["id"].to_numpy(), return_index=True, return_inverse=True)
            nb = rows["nb"].to_numpy()
            place = np.minimum(np.searchsorted(ids, nb), len(ids) - 1)
            other = np.where(ids[place] == nb, place, -1)
            xy = lambda a, b: np.stack([rows[a].to_numpy(), rows[b].to_numpy()], 1)
            points, fixed, w = xy("x", "y")[first], xy("nx", "ny"), rows["w"].to_numpy()
            rng = np.random.default_rng([seed, r, int(rows["part"][0].as_py())])
            for e in range(each):
                _moved(points, own, other, fixed, w, 1.0 - (r * each + e) / (rounds * each), rng)
            return pa.table({"id": ids, "x": points[:, 0], "y": points[:, 1]})

        return run

    for r in range(rounds):
        there = at.select(F.col("id").alias("nb"), F.col("x").alias("nx"), F.col("y").alias("ny"))
        rows = edges.join(there, "nb").join(at, "id").withColumn("part", F.pmod(F.xxhash64("id", F.lit(r)), F.lit(parts)))
        moved = rows.groupBy("part").applyInArrow(mover(r), "id long, x double, y double")
        alone = at.join(edges.select("id").distinct(), "id", "left_anti")
        at = written(moved.union(alone), "places")
    return at


def umap(rows: DataFrame, k: int = 15, key: str = "vec_id", vec: str = "embedding", metric: str = "cosine", epochs: int = 200, seed: int = 1, part_points: int = PART_POINTS) -> DataFrame | None:
    """``key``, x, y of each row that has a vector; None for fewer than three of them, or vectors of more
    than one dimension."""
    known = rows.where(F.size(vec) > 0)
    seen = known.agg(F.count("*").alias("n"), F.min(F.size(vec)).alias("least"), F.max(F.size(vec)).alias("most")).first()
    if seen["n"] < 3 or seen["least"] != seen["most"]:
        return None
    k = max(2, min(k, seen["n"] - 1))
    edges = fuzzy_edges(knn_graph(known, k, key, vec, metric, seed), k)
    flat = written(plane(known.select(key, vec), key, vec).select(F.col(key).cast("long").alias("id"), "x", "y").dropDuplicates(["id"]), "axes")
    wide = flat.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 1.0
    noise = lambda n: (F.pmod(F.xxhash64("id", F.lit(n), F.lit(seed)), F.lit(10_000)) / 10_000.0 - 0.5) * 1e-3
    start = flat.select("id", (F.col("x") * (10.0 / wide) + noise(1)).alias("x"), (F.col("y") * (10.0 / wide) + noise(2)).alias("y"))
    made = layout(edges, start, epochs, part_points=part_points, seed=seed)
    return made.select(F.col("id").alias(key), "x", "y")
