"""The map: nearest-neighbour graph, layout, spanning tree, density clusters, ancestry."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonaria.operators import density, layout, neighbours, trees
from sonaria.operators import vectors as V


def brute_tree(points, min_points):
    """Core distances and the lengths of a minimum spanning tree (Prim)."""
    p = np.array(points, float)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, min_points - 1]
    w = np.maximum(np.maximum(core[:, None], core[None]), d)
    inside, best, lengths = {0}, w[0].copy(), []
    while len(inside) < len(p):
        best[list(inside)] = np.inf
        j = int(best.argmin())
        lengths.append(best[j])
        inside.add(j)
        best = np.minimum(best, w[j])
    return core, sorted(lengths), w


def brute_clusters(points, min_points, min_size):
    """Labels by the definition: components at every length, from the whole downwards."""
    _, _, w = brute_tree(points, min_points)
    n = len(points)

    def parts(members, length):
        """Components of edges shorter than ``length``."""
        left, out = set(members), []
        while left:
            stack, comp = [left.pop()], set()
            while stack:
                i = stack.pop()
                comp.add(i)
                near = [j for j in left if w[i, j] < length]
                left.difference_update(near)
                stack += near
            out.append(sorted(comp))
        return out

    def walk(members, born):
        """(worth, chosen clusters below or at this one)."""
        now, held = members, 0.0
        while True:
            sub = [w[i, j] for a, i in enumerate(now) for j in now[a + 1 :]]
            # the longest edge of the component's own tree
            length = min_max(now)
            pieces = [c for c in parts(now, length) if len(c) >= min_size]
            if len(pieces) == 1:
                held += (len(now) - len(pieces[0])) * (1 / length - 1 / born)
                now = pieces[0]
                continue
            held += len(now) * (1 / length - 1 / born)
            below = [walk(c, length) for c in pieces]
            worth = sum(b[0] for b in below)
            assert sub
            return (held, [members]) if not below or held >= worth else (worth, [c for b in below for c in b[1]])

    def min_max(members):
        sub = w[np.ix_(members, members)]
        inside, best, most = {0}, sub[0].copy(), 0.0
        while len(inside) < len(members):
            best[list(inside)] = np.inf
            j = int(best.argmin())
            most = max(most, best[j])
            inside.add(j)
            best = np.minimum(best, sub[j])
        return most

    # the root is never chosen: shed its noise, then take what its parts are worth
    now = list(range(n))
    while True:
        length = min_max(now)
        pieces = [c for c in parts(now, length) if len(c) >= min_size]
        if len(pieces) != 1:
            break
        now = pieces[0]
    labels = [-1] * n
    for c in (c for piece in pieces for c in walk(piece, length)[1]):
        for i in c:
            labels[i] = min(c)
    return labels


def clouds(seed, sizes, noise=0):
    r = random.Random(seed)
    out = []
    for i, n in enumerate(sizes):
        cx, cy, s = r.uniform(0, 100), r.uniform(0, 100), r.uniform(0.5, 3)
        out += [(r.gauss(cx, s), r.gauss(cy, s)) for _ in range(n)]
    return out + [(r.uniform(0, 100), r.uniform(0, 100)) for _ in range(noise)]


def frame(spark, points):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "clip_id long, x double, y double").repartition(4)


@pytest.mark.parametrize("few", [50_000, 0])
def test_spanning_tree_is_that_of_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(density, "FEW_EDGES", few)
    n = 500 if few else 120
    points = clouds(1, [n // 3, n // 4], n - n // 3 - n // 4)
    rows = frame(spark, points).selectExpr("clip_id AS id", "x", "y", "1L AS n").cache()
    _, _, extent = density._box(rows)
    side = density._first_side(rows, extent)
    cores = density.core_distances(rows, 4, side, extent)
    want, lengths, _ = brute_tree(points, 5)
    got = {r.id: r.core for r in cores.collect()}
    assert all(math.isclose(got[i], c, rel_tol=1e-9) for i, c in enumerate(want))
    tree = density.spanning_tree(rows.select("id", "x", "y").join(cores, "id"), side, extent).collect()
    assert len(tree) == n - 1
    assert np.allclose(sorted(r.w for r in tree), lengths, rtol=1e-9)


@pytest.mark.parametrize("block,rounds", [(1000, 0), (25, None)])
def test_many_edges_are_joined_in_blocks(spark, monkeypatch, block, rounds):
    # no rounds of labels that go from neighbour to neighbour where a block holds all; the tree is that of brute force
    made = []
    keep = density.written
    monkeypatch.setattr(density, "written", lambda df, label: made.append(label) or keep(df, label))
    monkeypatch.setattr(density, "FEW_EDGES", 0)
    monkeypatch.setattr(density, "BLOCK_COMPONENTS", block)
    points = clouds(9, [60, 50], 40) + [(50.0 + i % 6, 50.0 + i // 6) for i in range(30)]  # many equal lengths
    rows = frame(spark, points).selectExpr("clip_id AS id", "x", "y", "1L AS n").cache()
    x0, y0, extent = density._box(rows)
    rows = rows.selectExpr("id", f"x - ({x0}) AS x", f"y - ({y0}) AS y", "n")
    side = density._first_side(rows, extent)
    cores = density.core_distances(rows, 4, side, extent)
    tree = density.spanning_tree(rows.select("id", "x", "y").join(cores, "id"), side, extent).collect()
    assert len(tree) == len(points) - 1
    assert np.allclose(sorted(r.w for r in tree), brute_tree(points, 5)[1], rtol=1e-9)
    assert "block-trees" in made and (rounds is None or made.count("roots") == rounds)


@pytest.mark.parametrize("seed,sizes,noise,ranges", [(2, [40, 60, 25], 30, 1), (3, [90], 20, 1), (4, [20, 20, 20, 20], 0, 1), (6, [30, 50], 10, 4)])
def test_clusters_are_those_of_the_definition(spark, monkeypatch, seed, sizes, noise, ranges):
    points = clouds(seed, sizes, noise)
    monkeypatch.setattr(density, "RANGE_EDGES", -(-len(points) // ranges))
    got = {r.clip_id: r.cluster for r in density.hdbscan(frame(spark, points)).collect()}
    assert [got[i] for i in range(len(points))] == brute_clusters(points, 5, 8)


def test_two_clouds_and_five_others_are_two_clusters(spark):
    r = random.Random(42)
    points = [(r.uniform(0, 2), r.uniform(0, 2)) for _ in range(60)] + [(r.uniform(100, 102), r.uniform(100, 102)) for _ in range(60)] + [(r.uniform(0, 200), r.uniform(0, 200)) for _ in range(5)]
    got = {x.clip_id: x.cluster for x in density.hdbscan(frame(spark, points)).collect()}
    assert len(got) == 125 and len({c for c in got.values() if c >= 0}) == 2
    assert len({got[i] for i in range(60)}) == 1 and len({got[i] for i in range(60, 120)}) == 1


def test_few_points_equal_points_and_points_without_places(spark):
    assert density.hdbscan(frame(spark, clouds(1, [15]))) is None
    assert density.hdbscan(frame(spark, [])) is None
    same = density.hdbscan(frame(spark, [(1.0, 1.0)] * 20 + [(9.0, 9.0)] * 20 + [(5.0, 5.5)])).collect()
    assert sorted({x.cluster for x in same if x.clip_id < 40}) == [0, 20] and {x.cluster for x in same if x.clip_id == 40} == {20}  # nearer to the second place than the two are to one another
    rows = frame(spark, clouds(5, [30, 30])).union(spark.createDataFrame([(900, None, 1.0), (901, float("nan"), 2.0)], "clip_id long, x double, y double"))
    got = {x.clip_id: x.cluster for x in density.hdbscan(rows).collect()}
    assert got[900] == got[901] == -1 and len(got) == 62


def test_auto_falls_back_to_the_grid_for_few_points_only(spark):
    rows, said = V.cluster_auto(frame(spark, clouds(1, [10])))
    assert said.startswith("grid") and rows.count() == 10
    rows, said = V.cluster_auto(frame(spark, clouds(7, [40, 40])))
    assert said.startswith("density: 2 clusters") and rows.count() == 80


def test_auto_joins_many_edges_without_rounds_of_labels(spark, monkeypatch):
    made = []
    keep = density.written
    monkeypatch.setattr(density, "written", lambda df, label: made.append(label) or keep(df, label))
    monkeypatch.setattr(density, "FEW_EDGES", 0)
    rows, said = V.cluster_auto(frame(spark, clouds(7, [40, 40])))
    assert said.startswith("density: 2 clusters") and rows.count() == 80
    assert "block-trees" in made and "roots" not in made


# neighbours and layout


def vectors(seed, n, dim=16, kinds=6):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((kinds, dim))
    return centres[r.integers(0, kinds, n)] + 0.35 * r.standard_normal((n, dim))


def vector_frame(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<float>").repartition(4)


def brute_neighbours(m, k, metric):
    d = neighbours.distances(m, m, metric)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_neighbours_recall(spark, metric):
    m = vectors(1, 1500).astype(np.float32)
    got = {}
    for r in neighbours.knn_graph(vector_frame(spark, m), 15, metric=metric).collect():
        got.setdefault(r.id, set()).add(r.nb)
    want = brute_neighbours(m.astype(float), 15, metric)
    assert all(len(v) == 15 and i not in v for i, v in got.items()) and len(got) == 1500
    assert np.mean([len(got[i] & set(want[i].tolist())) / 15 for i in range(1500)]) >= 0.95


def test_neighbours_of_awkward_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, []), (4, [1.0, 2.0, 3.0]), (5, [0.0, 0.0]), (6, [1.0, 0.0]), (6, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.knn_graph(df, 3).collect()
    assert {r.id for r in got} == {0, 1, 5, 6} and all(r.d >= 0 for r in got)
    assert neighbours.knn_graph(df.limit(0), 3).count() == 0
    assert neighbours.knn_graph(df.where("vec_id = 0"), 3).count() == 0


def test_equal_vectors_fill_many_chunks(spark):
    m = np.concatenate([np.ones((1200, 8)), vectors(3, 300, 8)])
    got = neighbours.knn_graph(vector_frame(spark, m), 5).groupBy("id").count().collect()
    assert len(got) == 1500 and {r["count"] for r in got} == {5}


def trustworthiness(m, flat, k):
    """How few points are near in the plane and far in space (Venna and Kaski)."""
    d = neighbours.distances(m, m, "cosine")
    np.fill_diagonal(d, np.inf)
    rank = d.argsort(axis=1).argsort(axis=1)
    e = neighbours.distances(flat, flat, "euclidean")
    np.fill_diagonal(e, np.inf)
    near = e.argsort(axis=1)[:, :k]
    n = len(m)
    worse = np.maximum(np.take_along_axis(rank, near, 1) - k + 1, 0).sum()
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * worse


@pytest.mark.parametrize("part_points", [layout.PART_POINTS, 300])
def test_layout_keeps_neighbours_better_than_two_axes(spark, part_points):
    m = vectors(2, 1000, 16, 12)
    rows = vector_frame(spark, m)
    place = lambda df: np.array([(r.x, r.y) for r in df.orderBy("vec_id").collect()])
    made = place(layout.umap(rows, part_points=part_points))
    assert made.shape == (1000, 2) and np.isfinite(made).all()
    axes = place(V.plane(rows))
    own, plain = trustworthiness(m, made, 12), trustworthiness(m, axes, 12)
    assert own > 0.85 and own > plain + 0.03, (own, plain)


def test_layout_of_few_points(spark):
    assert layout.umap(vector_frame(spark, vectors(1, 2))) is None
    assert layout.umap(vector_frame(spark, vectors(1, 30)).limit(0)) is None
    mixed = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0]), (2, [3.0]), (3, [1.0])], "vec_id long, embedding array<float>")
    assert layout.umap(mixed) is None
    assert layout.umap(vector_frame(spark, vectors(1, 5))).count() == 5


def test_weights_are_symmetric_and_one_for_the_nearest(spark):
    m = vectors(1, 200)
    graph = neighbours.knn_graph(vector_frame(spark, m), 10)
    w = {(r.id, r.nb): r.w for r in layout.fuzzy_edges(graph, 10).collect()}
    assert all(math.isclose(w[b, a], x) and 0 <= x <= 1 + 1e-9 for (a, b), x in w.items())
    nearest = {r.id: min((x.d, x.nb) for x in graph.where(f"id = {r.id}").collect())[1] for r in graph.select("id").distinct().limit(5).collect()}
    assert all(math.isclose(w[i, j], 1.0) for i, j in nearest.items())


# ancestry


def test_long_chains_in_few_rounds_and_cycles(spark):
    n = 3000
    rows = [(i, i - 1 if i else None) for i in range(n)] + [(n + 1, n + 2), (n + 2, n + 1), (n + 3, n + 1), (n + 4, 10**9), (n + 5, n + 5), (7, 6), (None, 3)]
    got = {r.id: (r.root, r.depth) for r in trees.roots_and_depths(spark.createDataFrame(rows, "id long, parent long"), "id", "parent").withColumnRenamed("node", "id").collect()}
    assert all(got[i] == (0, i) for i in range(n))
    assert [got[n + i] for i in (1, 2, 3, 5)] == [(None, None)] * 4 and got[n + 4] == (n + 4, 0)
    assert len(got) == n + 5
    assert trees.roots_and_depths(spark.createDataFrame([], "id long, parent long"), "id", "parent").count() == 0


def test_vectors_travel_in_the_width_they_were_given(spark):
    # single precision rows are not widened before they are sent, and lists are those of wide ones
    rng = np.random.default_rng(8)
    wide = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.random((60, 6)).astype(np.float32))], "vec_id long, embedding array<double>")
    narrow = wide.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    made = [sorted((r.id, r.nb) for r in neighbours.knn_graph(rows, k=4).collect()) for rows in (wide, narrow)]
    assert made[0] == made[1]
    assert dict(neighbours.vectors_of(narrow, "vec_id", "embedding").dtypes)["v"] == "array<float>"
