"""Vector analytics: cosine, neighbours, means, percentiles, diverse picks, grid clusters, projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonaria.functions.scalars import squared
from sonaria.operators.relational import global_ranks
from sonaria.sources.shared import written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for different dimensions or a zero vector."""
    norms = F.sqrt(squared(a) * squared(b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def nearest(rows: DataFrame, query: list[float], k: int, key: str = "vec_id", vec: str = "embedding", without: int | None = None) -> DataFrame:
    """The ``k`` rows most like one query vector; rows of another dimension or of length zero are skipped.

    Each task keeps its own best ``k``, and only those meet.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    own = F.sqrt(squared(F.col(vec)))
    fit = rows.where((F.size(vec) == len(query)) & (own > 0) & F.lit(norm > 0))
    fit = fit if without is None else fit.where(F.col(key) != without)
    return fit.withColumn("similarity", dot(F.col(vec), q) / (own * norm)).orderBy(F.desc("similarity"), key).limit(k)


def mean_vectors(rows: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """Keys, n and the element-wise mean of unit length; means are merged by position."""
    parts = rows.select(*keys, F.posexplode(vec).alias("pos", "x"))
    means = parts.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    made = means.groupBy(*keys).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("ms"))
    v = F.transform("ms", lambda x: x["m"])
    norm = F.sqrt(squared(v))
    return made.select(*keys, "n", F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x)).alias("vec"))


def percentiles(rows: DataFrame, key: str, dims: dict[str, tuple[int, bool]], vec: str) -> DataFrame:
    """``key`` and a percentile in 0..1 per named dimension (index, inverse); one row has 0.5, and a
    vector without the dimension none. All dimensions are ranked at once, by (dimension, value)."""
    values = [F.struct(F.lit(name).alias("dim"), F.get(vec, F.lit(index)).cast("double").alias("v")) for name, (index, _) in dims.items()]
    tall = rows.select(key, F.explode(F.array(*values)).alias("x")).select(key, "x.dim", "x.v")
    ranked = global_ranks(tall, "v", ["dim"])
    p = F.when(F.col("n") > 1, F.col("less") / (F.col("n") - 1)).when(F.col("n") == 1, 0.5)
    shares = [F.max(F.when(F.col("dim") == name, F.round(1 - p if inverse else p, 6))).alias(name) for name, (_, inverse) in dims.items()]
    return ranked.groupBy(key).agg(*shares)


def cluster_meta(points: DataFrame) -> DataFrame:
    """Size, share, centre, libraries, main library and the point nearest to the centre of each cluster."""
    total = points.agg(F.count("*").alias("__n"))
    valid = points.where("cluster >= 0")
    centres = valid.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    per = valid.groupBy("cluster", "library_id").agg(F.count("*").alias("c"))
    main = per.groupBy("cluster").agg(F.count("*").alias("libraries"), F.min(F.struct((-F.col("c")).alias("c"), "library_id"))["library_id"].alias("main_library"))
    far = F.round((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")), 12)
    middle = valid.join(centres.select("cluster", "cx", "cy"), "cluster").groupBy("cluster").agg(F.min(F.struct(far.alias("d"), "clip_id"))["clip_id"].alias("representative"))
    share = F.round(100.0 * F.col("n") / F.col("__n"), 2).alias("share")
    made = centres.join(main, "cluster").join(middle, "cluster").crossJoin(total)  # one row
    return made.select("cluster", "n", share, F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "libraries", "main_library", "representative")


def grid_cells(points: DataFrame, target: int = 12) -> DataFrame:
    """Adds gx, gy: the cell of a grid of g by g over the points' box, g from their number."""
    s = points.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    g = int(max(4, min(120, (s["n"] / target) ** 0.5)))
    cell = lambda c, a, b: F.least(F.floor((F.col(c) - a) / ((b - a) or 1.0) * g), F.lit(g - 1)).cast("int")
    return points.withColumn("gx", cell("x", s["x0"] or 0.0, s["x1"] or 0.0)).withColumn("gy", cell("y", s["y0"] or 0.0, s["y1"] or 0.0)).withColumn("g", F.lit(g))


def grid_cluster(points: DataFrame, target: int = 12) -> DataFrame:
    """clip_id and its cluster: the smallest cell (gx·g+gy) of the connected cells it lies in.

    At most 14 400 cells whatever the number of points; their labels spread to neighbours until
    they stand still, and go back to the points.
    """
    placed = grid_cells(points, target)
    cells = placed.select("gx", "gy", (F.col("gx") * F.col("g") + F.col("gy")).alias("label")).distinct()
    spark = points.sparkSession
    rows = {(r.gx, r.gy): r.label for r in cells.collect()}  # at most 120 x 120
    changed = True
    while changed:
        changed = False
        for (x, y), label in rows.items():
            low = min([label] + [rows[p] for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)) if p in rows])
            if low < label:
                rows[(x, y)] = low
                changed = True
    labels = spark.createDataFrame([(x, y, v) for (x, y), v in rows.items()], "gx int, gy int, cluster int")
    return placed.drop("cluster").join(F.broadcast(labels), ["gx", "gy"]).select("clip_id", "cluster")


def dense_clusters(points: DataFrame, cell: float, min_points: int = 5, min_size: int = 8) -> DataFrame:
    """clip_id and cluster by density; -1 is noise.

    Cells of side ``cell`` with ``min_points`` in their 3 by 3 block are dense, and touching dense
    cells make a cluster if it holds ``min_size`` points; the label is its smallest cell. The work
    is on cells, so its cost does not grow with the points of a cell.
    """
    at = points.select("clip_id", "x", "y").withColumn("gx", F.floor(F.col("x") / cell)).withColumn("gy", F.floor(F.col("y") / cell))
    counts = at.groupBy("gx", "gy").agg(F.count("*").alias("n"))
    shift = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("s")
    near = counts.select("gx", "gy", "n", shift).select((F.col("gx") + F.col("s.dx")).alias("gx"), (F.col("gy") + F.col("s.dy")).alias("gy"), "n").groupBy("gx", "gy").agg(F.sum("n").alias("around"))
    dense = counts.join(near, ["gx", "gy"]).where(F.col("around") >= min_points).select("gx", "gy")
    labels = dense.withColumn("label", F.struct("gx", "gy"))
    while True:
        spread = labels.select("label", "gx", "gy", shift).select((F.col("gx") + F.col("s.dx")).alias("gx"), (F.col("gy") + F.col("s.dy")).alias("gy"), "label").groupBy("gx", "gy").agg(F.min("label").alias("new"))
        step = labels.join(spread, ["gx", "gy"]).select("gx", "gy", F.least("label", "new").alias("label"), (F.col("new") < F.col("label")).alias("moved"))
        # follow the label's own label, so that chains halve
        roots = step.select(F.col("gx").alias("rx"), F.col("gy").alias("ry"), F.col("label").alias("root"))
        jumped = step.join(roots, (F.col("label.gx") == F.col("rx")) & (F.col("label.gy") == F.col("ry"))).select("gx", "gy", F.col("root").alias("label"), ((F.col("root") < F.col("label")) | F.col("moved")).alias("moved"))
        jumped = written(jumped, "labels")
        labels = jumped.select("gx", "gy", "label")
        if not jumped.where("moved").limit(1).count():
            break
    sizes = at.join(labels, ["gx", "gy"]).groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    named = labels.join(sizes, "label").select("gx", "gy", F.concat_ws(":", F.col("label.gx").cast("string"), F.col("label.gy").cast("string")).alias("cluster"))
    return at.join(named, ["gx", "gy"], "left").select("clip_id", F.coalesce("cluster", F.lit("-1")).alias("cluster"))


def cluster_auto(points: DataFrame, target: int = 5) -> tuple[DataFrame, str]:
    """clip_id and cluster by density, or by the grid where there are too few points; and a summary."""
    from sonaria.operators.density import hdbscan

    dense = hdbscan(points)
    if dense is not None:
        dense = written(dense, "clusters")
        found = dense.agg(F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"), F.count_if(F.col("cluster") < 0).alias("noise")).first()
        return dense, f"density: {found['clusters']} clusters, {found['noise']} noise points"
    grid = grid_cluster(points, target).select("clip_id", F.col("cluster").cast("long").alias("cluster"))
    return grid, f"grid: {grid.select('cluster').distinct().count()} clusters"


def plane(rows: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """key, x, y: the two main axes of the vectors, from Spark's own principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = rows.select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("v"))
    made = PCA(k=2, inputCol="v", outputCol="p").fit(data).transform(data)
    xy = vector_to_array("p")
    return made.select(key, xy[0].alias("x"), xy[1].alias("y"))


def top_per_row(pairs: DataFrame, key: str, score: str, tie: str, k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(score), tie)
    return pairs.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")
