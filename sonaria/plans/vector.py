"""Vector, map and clustering queries over the embeddings."""

from pyspark.sql import functions as F

from sonaria.operators import neighbours
from sonaria.operators import vectors as V
from sonaria.operators.density import hdbscan
from sonaria.operators.diverse import core_set, diverse_candidates
from sonaria.operators.layout import umap
from sonaria.plans.registry import query

_COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7))"


def _seed(c, vec_id: int = 7):
    row = c.table("embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row["embedding"])


@query("cosine_similarity", "", f"SELECT vec_id, round({_COS}, 5) AS similarity FROM embeddings")
def cosine_similarity(c):
    q = F.array(*[F.lit(float(x)) for x in _seed(c)])
    return c.table("embeddings").select("vec_id", F.round(V.cosine(F.col("embedding"), q), 5).alias("similarity"))


@query("knn_topk", "", f"SELECT vec_id, round({_COS}, 5) AS similarity FROM embeddings WHERE vec_id <> 7 ORDER BY {_COS} DESC, vec_id LIMIT 20")
def knn_topk(c, k: int = 20):
    return V.nearest(c.table("embeddings"), _seed(c), max(1, min(200, k)), without=7).select("vec_id", F.round("similarity", 5).alias("similarity"))


@query("knn_same_library", "", f"SELECT vec_id, round({_COS}, 5) AS similarity FROM embeddings WHERE vec_id <> 7 AND vec_id % 7 = 0 ORDER BY {_COS} DESC, vec_id LIMIT 12")
def knn_same_library(c):
    rows = c.table("embeddings").where("vec_id % 7 = 0")
    return V.nearest(rows, _seed(c), 12, without=7).select("vec_id", F.round("similarity", 5).alias("similarity"))


@query("knn_seed_by_name", "points", "SELECT min(e.vec_id) AS vec_id FROM embeddings e JOIN part p ON e.vec_id = p.p_partkey WHERE contains(p.p_name, 'gizmo')")
def knn_seed_by_name(c, text: str = "gizmo"):
    named = c("instruments").where(F.contains("name", F.lit(text))).select(F.col("id").alias("vec_id"))
    return c.table("embeddings").select("vec_id").join(named, "vec_id", "left_semi").agg(F.min("vec_id").alias("vec_id"))


@query("map_detail", "points", f"WITH k AS (SELECT vec_id, {_COS} AS s FROM embeddings WHERE vec_id <> 7 ORDER BY s DESC, vec_id LIMIT 12) SELECT k.vec_id, round(k.s, 5) AS similarity, p.cluster, i.p_name AS name FROM k JOIN points p ON p.clip_id = k.vec_id JOIN part i ON i.p_partkey = k.vec_id")
def map_detail(c):
    """The twelve neighbours of a point with their names and clusters."""
    near = V.nearest(c.table("embeddings"), _seed(c), 12, without=7).select("vec_id", F.round("similarity", 5).alias("similarity"))
    names = c("instruments").select(F.col("id").alias("vec_id"), "name")
    points = c("points").select(F.col("clip_id").alias("vec_id"), "cluster")
    return points.join(F.broadcast(near), "vec_id").join(names, "vec_id")  # twelve rows


@query("mean_vector", "", """WITH p AS (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM p GROUP BY 1, 2)
    SELECT label, (SELECT count(*) FROM embeddings e WHERE e.label = m.label) AS n, round(sqrt(sum(m * m)) / sqrt(sum(m * m)), 5) AS norm, round(max(m) / sqrt(sum(m * m)), 5) AS top FROM m GROUP BY label""")
def mean_vector(c):
    made = V.mean_vectors(c.table("embeddings").select("label", "embedding"), ["label"], "embedding")
    return made.select("label", "n", F.round(F.sqrt(V.squared(F.col("vec"))), 5).alias("norm"), F.round(F.array_max("vec"), 5).alias("top"))


@query("instrument_mean_vectors", "", """WITH p AS (SELECT vec_id % 7 AS library_id, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT library_id, label, i, avg(x) AS m, count(*) AS n FROM p GROUP BY 1, 2, 3)
    SELECT library_id, label, max(n) AS n, round(max(m) / sqrt(sum(m * m)), 5) AS top FROM m GROUP BY 1, 2""")
def instrument_mean_vectors(c):
    rows = c.table("embeddings").select((F.col("vec_id") % 7).alias("library_id"), "label", "embedding")
    return V.mean_vectors(rows, ["library_id", "label"], "embedding").select("library_id", "label", "n", F.round(F.array_max("vec"), 5).alias("top"))


TIMBRE = {"brightness": (26, False), "rolloff": (27, False), "flatness": (28, False), "crest": (29, False), "loudness": (30, False), "punch": (31, True)}
_P = ", ".join(f"round({'1 - ' if inv else ''}percent_rank() OVER (ORDER BY embedding[{i + 1}]), 6) AS {n}" for n, (i, inv) in TIMBRE.items())


@query("timbre_percentiles", "", f"SELECT vec_id, {_P} FROM embeddings")
def timbre_percentiles(c):
    return V.percentiles(c.table("embeddings"), "vec_id", TIMBRE, "embedding")


@query("timbre_filter", "", f"WITH p AS (SELECT vec_id, {_P} FROM embeddings) SELECT vec_id FROM p WHERE brightness BETWEEN 0.25 AND 0.9 AND punch >= 0.5")
def timbre_filter(c):
    """Closed intervals on percentiles; dimensions without bounds are not computed."""
    chosen = {k: TIMBRE[k] for k in ("brightness", "punch")}
    p = V.percentiles(c.table("embeddings"), "vec_id", chosen, "embedding")
    return p.where(F.col("brightness").between(0.25, 0.9) & (F.col("punch") >= 0.5)).select("vec_id")


@query(
    "grid_cluster",
    "points",
    """RECURSIVE WITH s AS (SELECT least(greatest(CAST(floor(sqrt(count(*) / 12.0)) AS INT), 4), 120) AS g, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points),
    c AS (SELECT clip_id, CAST(least(floor((x - x0) / (x1 - x0) * g), g - 1) AS INT) AS gx, CAST(least(floor((y - y0) / (y1 - y0) * g), g - 1) AS INT) AS gy, g FROM points, s),
    cells AS (SELECT DISTINCT gx, gy, gx * g + gy AS id FROM c),
    reach(id, root) AS (SELECT id, id FROM cells UNION SELECT b.id, r.root FROM reach r JOIN cells a ON a.id = r.id JOIN cells b ON abs(a.gx - b.gx) + abs(a.gy - b.gy) = 1)
    SELECT c.clip_id, min(r.root) AS cluster FROM c JOIN reach r ON r.id = c.gx * c.g + c.gy GROUP BY c.clip_id""",
)
def grid_cluster(c):
    return V.grid_cluster(c("points"))


@query("density_clusters")
def density_clusters(c):
    return V.dense_clusters(c("points"), 0.05)


@query("hdbscan_2d")
def hdbscan_2d(c):
    """Density clusters of the map's points; -1 is noise."""
    return hdbscan(c("points"))


@query("cluster_auto", "points", "SELECT CASE WHEN count(*) < 16 THEN 'grid' ELSE 'density' END AS kind, count(*) AS points FROM points")
def cluster_auto(c):
    """Too few points for density clusters go by the grid; every point has a cluster."""
    rows, said = V.cluster_auto(c("points"))
    return rows.groupBy(F.lit(said.split(":")[0]).alias("kind")).agg(F.count("cluster").alias("points"))


@query("knn_graph")
def knn_graph(c):
    """The fifteen nearest neighbours of every vector."""
    return neighbours.knn_graph(c.table("embeddings"))


@query("umap_2d")
def umap_2d(c):
    """A layout of all vectors that keeps neighbours together."""
    return umap(c.table("embeddings"))


@query("map_projection")
def map_projection(c):
    return V.plane(c.table("embeddings")).select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("diverse_core_set")
def diverse_core_set(c):
    """Six vectors, each the farthest from all before, in one pass over all."""
    return core_set(c.table("embeddings"), 6)


@query("farthest_point_sampling")
def farthest_point_sampling(c):
    """Diverse clips for a question, with companions from their libraries and related words where libraries lack."""
    clips = c("clips")
    vectors = clips.select("id", (F.col("id") % 500).alias("vec_id")).join(c.table("embeddings").select("vec_id", F.col("embedding").alias("vec")), "vec_id")
    return diverse_candidates(clips, vectors, "clip 1234", 8, 3, 4, related=["clip 432"])
