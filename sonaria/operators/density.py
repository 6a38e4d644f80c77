"""Hierarchical density clusters of points in a plane.

A point's core distance is that to its ``min_points - 1``-th nearest other point; two points are
as far apart as the largest of their distance and their core distances (mutual reachability). The
minimum spanning tree of that distance, cut from its longest edges on, gives a hierarchy in which
groups of fewer than ``min_size`` points are no clusters; of a cluster and those below it, the one
stays whose points stay together over the wider range of 1/distance (excess of mass).

Everything is found on grids whose side grows from round to round. In a round only what is within
one side is looked for, so three by three cells suffice; what an earlier round has settled takes no
part: points with a core distance, and points whose neighbourhood is one component. Cells are cut
into 8 by 8 smaller ones whose boxes and counts bound all distances between two of them, and only
pairs of small cells that may hold the nearest points are looked into. Points of one place are one
location with a count, so no cell is crowded by copies. The tree is built from the components' nearest
edges: blocks of neighbouring components are joined each for itself, as far as no edge that leaves the block
is shorter, and only what lies at the blocks' borders meets again. Its hierarchy comes from ranges of edges of
ascending length, one group for each component.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sonaria.operators.trees import highest
from sonaria.sources.shared import written

#: Edges of a round that the driver joins itself; with more of them blocks are joined first.
FEW_EDGES = 50_000
#: Components of a block, and edges for each of them on the average.
BLOCK_COMPONENTS = 25_000
BLOCK_EDGES = 8 * BLOCK_COMPONENTS
#: Edges of one range of the hierarchy: what one group holds at most, equal lengths apart.
RANGE_EDGES = 2_000_000
#: Cells of the first round hold so many locations at most.
FIRST_CELL = 32
SUB = 8
#: The side of a round as a multiple of that before it.
GROWTH = 3
_SHIFTS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def _box(rows: DataFrame) -> tuple[float, float, float]:
    b = rows.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    return b[0], b[2], max(b[1] - b[0], b[3] - b[2])


def _first_side(rows: DataFrame, extent: float) -> float:
    """A side with which no cell holds more than ``FIRST_CELL`` locations, or the smallest that makes sense."""
    side = extent / 4
    while side > extent * 1e-9:
        most = rows.groupBy(F.floor(F.col("x") / side), F.floor(F.col("y") / side)).count().agg(F.max("count")).first()[0]
        if most <= FIRST_CELL:
            break
        side /= 4
    return side


def _placed(rows: DataFrame, side: float) -> DataFrame:
    """Adds the cell (gx, gy) and the small cell (ux, uy) of each location."""
    small = side / SUB
    rows = rows.withColumn("ux", F.floor(F.col("x") / small)).withColumn("uy", F.floor(F.col("y") / small))
    return rows.withColumn("gx", F.floor(F.col("ux") / SUB)).withColumn("gy", F.floor(F.col("uy") / SUB))


def _around(rows: DataFrame) -> DataFrame:
    """Each row once for each of the nine cells around it, named gx, gy."""
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _SHIFTS])
    rows = rows.withColumn("__s", F.explode(shifts))
    return rows.withColumn("gx", F.col("gx") + F.col("__s.i")).withColumn("gy", F.col("gy") + F.col("__s.j")).drop("__s")


def _apart(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def _gap(lo: str, hi: str, olo: str, ohi: str) -> Column:
    return F.greatest(F.col(olo) - F.col(hi), F.col(lo) - F.col(ohi), F.lit(0.0))


def _reach(lo: str, hi: str, olo: str, ohi: str) -> Column:
    return F.greatest(F.col(ohi) - F.col(lo), F.col(hi) - F.col(olo))


def core_distances(rows: DataFrame, k: int, side: float, extent: float) -> DataFrame:
    """id, core: the distance of each location's ``k``-th nearest other point, of rows id, x, y, n."""
    done = rows.where(F.col("n") > k).select("id", F.lit(0.0).alias("core"))
    open_ = rows.where(F.col("n") <= k)
    while True:
        placed = _placed(rows, side)
        boxes = placed.groupBy("gx", "gy", "ux", "uy").agg(F.sum("n").alias("m"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
        asked = _around(_placed(open_, side).select("id", "n", "x", "y", "gx", "gy")).join(boxes, ["gx", "gy"])
        asked = asked.withColumn("least", F.hypot(_gap("x", "x", "x0", "x1"), _gap("y", "y", "y0", "y1"))).withColumn("most", F.hypot(_reach("x", "x", "x0", "x1"), _reach("y", "y", "y0", "y1")))
        # a small cell with more than k points holds k others, all within its far corner
        far = F.min(F.when(F.col("m") > k, F.col("most"))).over(Window.partitionBy("id"))
        asked = asked.withColumn("far", F.least(F.coalesce(far, F.lit(side)), F.lit(side))).where(F.col("least") <= F.col("far")).select("id", F.col("n").alias("own"), F.col("x").alias("px"), F.col("y").alias("py"), "ux", "uy")
        others = placed.select(F.col("id").alias("other"), "n", "x", "y", "ux", "uy")
        d = _apart(F.col("px"), F.col("py"), F.col("x"), F.col("y"))
        met = asked.join(others, ["ux", "uy"]).where(F.col("id") != F.col("other")).withColumn("d", d).where(F.col("d") <= side)
        near = met.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))).where(F.col("r") <= k)
        # the points of the locations up to each of the k nearest, and the copies of the location itself
        counted = near.withColumn("sum", F.col("own") - 1 + F.sum("n").over(Window.partitionBy("id").orderBy("d", "other").rowsBetween(Window.unboundedPreceding, 0)))
        found = written(counted.where(F.col("sum") >= k).groupBy("id").agg(F.min("d").alias("core")), "cores")
        done = done.unionByName(found)
        open_ = written(open_.join(found, "id", "left_anti"), "open")
        if side > 2 * extent or not open_.limit(1).count():
            return written(done.unionByName(open_.select("id", F.lit(float("inf")).alias("core"))), "core-distances")
        side *= GROWTH


def _min_edges(rows: DataFrame, side: float) -> DataFrame:
    """ca < cb, best(w, d, a, b): the nearest edge of no more than ``side`` between each two components."""
    cells = rows.groupBy("gx", "gy").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mixed = _around(cells).groupBy("gx", "gy").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("gx", "gy")
    active = written(rows.join(mixed, ["gx", "gy"], "left_semi"), "active")
    bounds = [f(c).alias(name) for f, c, name in ((F.min, "x", "x0"), (F.max, "x", "x1"), (F.min, "y", "y0"), (F.max, "y", "y1"), (F.min, "core", "c0"), (F.max, "core", "c1"))]
    boxes = active.groupBy("gx", "gy", "ux", "uy", "comp").agg(*bounds)
    named = lambda p: boxes.select("gx", "gy", *[F.col(c).alias(p + c) for c in ("ux", "uy", "comp", "x0", "x1", "y0", "y1", "c0", "c1")])
    pairs = _around(named("a")).join(named("b"), ["gx", "gy"]).where("acomp < bcomp")
    least = F.greatest(F.hypot(_gap("ax0", "ax1", "bx0", "bx1"), _gap("ay0", "ay1", "by0", "by1")), F.col("ac0"), F.col("bc0"))
    most = F.greatest(F.hypot(_reach("ax0", "ax1", "bx0", "bx1"), _reach("ay0", "ay1", "by0", "by1")), F.col("ac1"), F.col("bc1"))
    pairs = written(pairs.select("aux", "auy", "acomp", "bux", "buy", "bcomp", least.alias("least"), most.alias("most")).where(F.col("least") <= side), "box-pairs")
    within = pairs.groupBy("acomp", "bcomp").agg(F.min("most").alias("enough"))
    pairs = pairs.join(within, ["acomp", "bcomp"]).where(F.col("least") <= F.col("enough"))
    point = lambda p: active.select(*[F.col(c).alias(p + c) for c in ("ux", "uy", "comp", "id", "x", "y", "core")])
    met = pairs.join(point("a"), ["aux", "auy", "acomp"]).join(point("b"), ["bux", "buy", "bcomp"])
    met = met.withColumn("d", _apart(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).withColumn("w", F.greatest("d", "acore", "bcore")).where(F.col("w") <= side)
    best = F.min(F.struct("w", "d", F.col("aid").alias("a"), F.col("bid").alias("b"))).alias("best")
    return met.groupBy(F.col("acomp").alias("ca"), F.col("bcomp").alias("cb")).agg(best)


def roots_of(links: DataFrame) -> DataFrame:
    """comp, root: the smallest component that each reaches over ``links`` (ca, cb), with ca its own too.

    Labels go to neighbours and to the label's own label, until they stand still."""
    both = written(links.select("ca", "cb").union(links.select("cb", "ca")).distinct(), "links")
    labels = both.groupBy(F.col("ca").alias("comp")).agg(F.least(F.min("cb"), F.first("ca")).alias("root"))
    while True:
        near = both.join(labels.select(F.col("comp").alias("cb"), "root"), "cb").groupBy(F.col("ca").alias("comp")).agg(F.min("root").alias("near"))
        step = labels.join(near, "comp").select("comp", "root", F.least("root", "near").alias("new"))
        up = step.select(F.col("comp").alias("new"), F.col("new").alias("up"))
        step = written(step.join(up, "new", "left").select("comp", F.least("new", "up").alias("next"), "root"), "roots")
        labels = step.select("comp", F.col("next").alias("root"))
        if not step.where("next <> root").limit(1).count():
            return labels


def _renamed(rows: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    named = roots.select(F.col("comp").alias(column), F.col("root").alias("__root"))
    return rows.join(named, column, "left").withColumn(column, F.coalesce("__root", column)).drop("__root")


def _interleaved(rows: DataFrame, extent: float, bits: int = 26) -> DataFrame:
    """id, z: a number of each location that neighbours in the plane mostly have near to one another."""

    def spread(column: str) -> Column:
        v = F.least(F.floor(F.col(column) / extent * 2**bits), F.lit(2**bits - 1)).cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return rows.select("id", spread("x").bitwiseOR(F.shiftleft(spread("y"), 1)).cast("double").alias("z"))


_FOREST = "a long, b long, w double, comp long, root long"


def _forest(block: pa.Table) -> pa.Table:
    """The edges of a block that are in the tree for certain, and its components' roots.

    A row without ``cb`` is the shortest edge by which ``ca`` leaves the block. Edges are taken as they ascend.
    One that joins two components is the shortest that leaves one of them, and so in the tree, unless both have a
    shorter one that leaves the block."""
    rows = block.sort_by([(c, "ascending") for c in ("w", "d", "a", "b")])
    root: dict[int, int] = {}
    leaving: set[int] = set()
    kept = []

    def top(c: int) -> int:
        while root.setdefault(c, c) != c:
            root[c] = c = root[root[c]]
        return c

    for at, (a, b) in enumerate(zip(rows.column("ca").to_pylist(), rows.column("cb").to_pylist())):
        a = top(a)
        if b is None:
            leaving.add(a)
            continue
        b = top(b)
        if a == b or (a in leaving and b in leaving):
            continue
        low, high = min(a, b), max(a, b)
        root[high] = low
        if high in leaving:
            leaving.add(low)
        kept.append(at)
    tree = rows.select(["a", "b", "w"]).take(pa.array(kept, pa.int64()))
    comps, blank = list(root), [None] * len(kept)
    ends = [pa.chunked_array([*tree.column(c).chunks, pa.nulls(len(comps), t)], t) for c, t in (("a", pa.int64()), ("b", pa.int64()), ("w", pa.float64()))]
    return pa.table(dict(zip(("a", "b", "w", "comp", "root"), [*ends, pa.array(blank + comps, pa.int64()), pa.array(blank + [top(c) for c in comps], pa.int64())])))


def _joined_in_blocks(edges: DataFrame, codes: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """a, b, w of edges that are in the tree, and comp, root of all components, from blocks of neighbours."""
    ends = written(edges.select(F.col("ca").alias("id")).union(edges.select("cb")).distinct().join(codes, "id"), "block-ends")
    parts = max(-(-ends.count() // BLOCK_COMPONENTS), -(-n // BLOCK_EDGES))
    cuts = sorted(set(ends.approxQuantile("z", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    if cuts:
        blocks = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="z", outputCol="block").transform(ends).select("id", F.col("block").cast("long").alias("block"))
    else:
        blocks = ends.select("id", F.lit(0).cast("long").alias("block"))
    of = lambda c: blocks.select(F.col("id").alias(c), F.col("block").alias(f"block_{c}"))
    placed = written(edges.join(of("ca"), "ca").join(of("cb"), "cb"), "block-edges")
    inside = placed.where("block_ca = block_cb").select(F.col("block_ca").alias("block"), "ca", "cb", "best")
    over = placed.where("block_ca <> block_cb")
    over = over.select(F.col("block_ca").alias("block"), "ca", "best").union(over.select("block_cb", "cb", "best"))
    over = over.groupBy("block", "ca").agg(F.min("best").alias("best")).select("block", "ca", F.lit(None).cast("long").alias("cb"), "best")
    known = inside.unionByName(over).select("block", "ca", "cb", "best.w", "best.d", "best.a", "best.b")
    out = written(known.groupBy("block").applyInArrow(_forest, _FOREST), "block-trees")
    return out.where("comp is null").select("a", "b", "w"), out.where("comp is not null").select("comp", "root")


def _joined_in_rounds(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b, w of the shortest edge of each component, and comp, root of all components (Boruvka)."""
    ends = edges.select(F.col("ca").alias("comp"), "ca", "cb", "best").union(edges.select("cb", "ca", "cb", "best"))
    chosen = written(ends.groupBy("comp").agg(F.min(F.struct("best", "ca", "cb")).alias("m")).select("m.best", "m.ca", "m.cb").distinct(), "chosen")
    return chosen.select("best.a", "best.b", "best.w"), written(roots_of(chosen), "merged")


def _joined(edges: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b, w: the forest of ``edges`` (ca, cb, best) of least length; and comp, root."""
    spark = edges.sparkSession
    trees, moved = [], None

    def follow(roots: DataFrame) -> DataFrame:
        if moved is None:
            return roots
        new = roots.join(moved.select("comp"), "comp", "left_anti")
        return written(_renamed(moved, roots, "root").select("comp", "root").union(new), "moved")

    n, by_blocks = edges.count(), True
    while n > FEW_EDGES:
        tree, roots = _joined_in_blocks(edges, codes, n) if by_blocks else _joined_in_rounds(edges)
        trees.append(tree)
        moved = follow(roots)
        left = _renamed(_renamed(edges, roots, "ca"), roots, "cb").where("ca <> cb")
        left = left.groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.min("best").alias("best"))
        edges = written(left.select(F.col("x").alias("ca"), F.col("y").alias("cb"), "best"), "edges")
        before, n = n, edges.count()
        # where blocks part too much, a round in which every component is joined to another comes between
        by_blocks = not by_blocks or n <= before / 2
    if n:
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while root.setdefault(c, c) != c:
                root[c] = c = root[root[c]]
            return c

        kept = []
        for e in sorted(edges.collect(), key=lambda e: tuple(e.best)):  # FEW_EDGES at most
            a, b = top(e.ca), top(e.cb)
            if a != b:
                root[max(a, b)] = min(a, b)
                kept.append((e.best.a, e.best.b, e.best.w))
        trees.append(spark.createDataFrame(kept, "a long, b long, w double"))
        moved = follow(spark.createDataFrame([(c, top(c)) for c in root], "comp long, root long"))
    return reduce(DataFrame.union, trees), moved


def spanning_tree(rows: DataFrame, side: float, extent: float) -> DataFrame:
    """a, b, w: a minimum spanning tree of the mutual reachability of rows id, x, y, core."""
    labels, edges = rows.select("id", F.col("id").alias("comp")), []
    codes = _interleaved(rows, extent)
    while True:
        placed = written(_placed(rows.join(labels, "id"), side), "placed")
        found = written(_min_edges(placed, side), "min-edges")
        if found.limit(1).count():
            tree, roots = _joined(found, codes)
            edges.append(written(tree, "tree"))
            labels = written(_renamed(labels, roots, "comp").select("id", "comp"), "components")
        if side > 3 * extent or labels.select("comp").distinct().limit(2).count() < 2:
            break
        side *= GROWTH
    return reduce(DataFrame.union, edges) if edges else rows.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("w")).limit(0)


_STATE = "comp long, size long, node long, members array<long>, held double, below double"
#: kind: a component's state, a cluster with its parent, or a location with its lowest cluster.
_OUT = f"kind string, {_STATE}, parent long, point long, own boolean"


class _Merger:
    """Components joined by ascending edges: their sizes and clusters, and what each cluster takes in.

    The label of a joined component is the smallest of its parts', and the others are never met again, so
    the largest numbers the cluster that begins there: twice it for the first cluster of its points, and
    one more where clusters meet in a wider one.
    """

    def __init__(self, state: list[dict], min_size: int, floor: float):
        self.min_size, self.floor = min_size, floor
        self.root = {s["comp"]: s["comp"] for s in state}
        self.at = {s["comp"]: s for s in state}
        self.out: list[dict] = []

    def top(self, c: int) -> int:
        while self.root[c] != c:
            self.root[c] = c = self.root[self.root[c]]
        return c

    def taken(self, node: int, points: list[int]) -> None:
        self.out += [{"kind": "point", "node": node, "point": p} for p in points]

    def closed(self, s: dict, density: float, parent: int | None) -> float:
        """A cluster ends as a part of ``parent``: what it, or those in it, are worth."""
        own = s["held"] - s["size"] * density
        self.out.append({"kind": "node", "node": s["node"], "parent": parent, "own": parent is not None and own >= s["below"]})
        return max(own, s["below"])

    def join(self, pairs: list[tuple[int, int]], w: float) -> None:
        """All edges of one length at once: what they join was apart below it."""
        density = 1.0 / max(w, self.floor)
        met: dict[int, set[int]] = {}
        for a, b in pairs:
            a, b = sorted((self.top(a), self.top(b)))
            if a != b:
                self.root[b] = a
                met[a] = met.pop(a, {a}) | met.pop(b, {b})
        for low, parts in met.items():
            states = [self.at.pop(p) for p in sorted(parts)]
            big = [s for s in states if s["node"] is not None]
            few = [p for s in states for p in s["members"]]
            size, last = sum(s["size"] for s in states), max(parts)
            made = {"comp": low, "size": size, "node": None, "members": [], "held": size * density, "below": 0.0}
            if len(big) > 1:
                made["node"] = 2 * last + 1
                made["below"] = sum(self.closed(s, density, made["node"]) for s in big)
            elif big:
                made |= {"node": big[0]["node"], "held": big[0]["held"] + (size - big[0]["size"]) * density, "below": big[0]["below"]}
            elif size >= self.min_size:
                made["node"] = 2 * last
            else:
                made |= {"members": few, "held": 0.0}
            if made["node"] is not None:
                self.taken(made["node"], few)
            self.at[low] = made


def _levels(edges: DataFrame, n: int) -> list[tuple[float, float]]:
    """Ranges of lengths, (above, up to], of about ``RANGE_EDGES`` edges each."""
    parts = -(-n // RANGE_EDGES)
    cuts = sorted(set(edges.approxQuantile("w", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    return list(zip([-1.0, *cuts], [*cuts, float("inf")]))


def hierarchy(rows: DataFrame, edges: DataFrame, min_size: int, floor: float) -> tuple[DataFrame, DataFrame]:
    """point, node: the lowest cluster of each location that has one; and node, parent, own of the clusters,
    from rows id, n and the tree. A cluster is ``own`` if it is worth as much as those in it."""
    schema = T._parse_datatype_string(_OUT)

    def run(state: pa.Table, held: pa.Table) -> pa.Table:
        merger = _Merger(state.drop_columns(["grp"]).to_pylist(), min_size, floor)
        edges = held.select(["w", "a", "b"]).sort_by([("w", "ascending"), ("a", "ascending"), ("b", "ascending")]).to_pylist()
        for w, equal in groupby(edges, key=lambda e: e["w"]):
            merger.join([(e["a"], e["b"]) for e in equal], w)
        out = merger.out + [{"kind": "state", **s} for s in merger.at.values()]
        return pa.Table.from_pylist(out, to_arrow_schema(schema))

    heavy = F.col("n") >= min_size
    density = F.lit(1.0 / floor)
    state = rows.select(
        F.col("id").alias("comp"), F.col("n").alias("size"), F.when(heavy, F.col("id") * 2).alias("node"), F.when(heavy, F.array().cast("array<long>")).otherwise(F.array("id")).alias("members"),
        F.when(heavy, F.col("n") * density).otherwise(0.0).alias("held"), F.lit(0.0).alias("below"),
    )
    outs = [rows.where(heavy).select(F.lit("point").alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (("comp", "long"), ("size", "long"))], (F.col("id") * 2).alias("node"), *[F.lit(None).cast(t).alias(c) for c, t in (("members", "array<long>"), ("held", "double"), ("below", "double"), ("parent", "long"))], F.col("id").alias("point"), F.lit(None).cast("boolean").alias("own"))]
    labels = rows.select("id", F.col("id").alias("comp"))
    levels = _levels(edges, edges.count())
    for above, upto in levels:
        here = edges.where((F.col("w") > above) & (F.col("w") <= upto))
        if len(levels) == 1:
            here, roots = here.withColumn("grp", F.lit(0).cast("long")), state.select("comp", F.lit(0).cast("long").alias("root"))
        else:
            ends = lambda c: labels.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}"))
            here = written(here.join(ends("a"), "a").join(ends("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"), "w"), "range")
            roots = written(roots_of(here.select(F.col("a").alias("ca"), F.col("b").alias("cb"))), "range-roots")
            here = here.join(roots.select(F.col("comp").alias("a"), F.col("root").alias("grp")), "a").select("a", "b", "w", "grp")
            labels = written(_renamed(labels, roots, "comp").select("id", "comp"), "range-labels")
        taking = state.join(roots, "comp").withColumnRenamed("root", "grp")
        out = written(taking.groupBy("grp").cogroup(here.groupBy("grp")).applyInArrow(run, _OUT), "hierarchy")
        rest = state.join(roots.select("comp"), "comp", "left_anti")
        state = rest.unionByName(out.where("kind = 'state'").select(*rest.columns))
        outs.append(out.where("kind <> 'state'"))
    told = reduce(DataFrame.unionByName, outs)
    top = state.where("node is not null").select("node", F.lit(None).cast("long").alias("parent"), F.lit(False).alias("own"))
    return told.where("kind = 'point'").select("point", "node"), told.where("kind = 'node'").select("node", "parent", "own").union(top)


def hdbscan(points: DataFrame, min_points: int = 5, min_size: int = 8, key: str = "clip_id") -> DataFrame | None:
    """``key`` and cluster of every point (x, y): the smallest key of its cluster, or -1 for noise.

    None where there are fewer than twice ``min_size`` points with coordinates. Points without them are
    noise; lengths below a 10^9th of the extent count as that.
    """
    placed = points.select(F.col(key).cast("long").alias("key"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    known = ~(F.col("x").isNull() | F.isnan("x") | F.col("y").isNull() | F.isnan("y"))
    places = placed.where(known).groupBy("x", "y").agg(F.min("key").alias("id"), F.count("*").alias("n"))
    places = written(places, "places")
    total = places.agg(F.sum("n")).first()[0] or 0
    if total < 2 * min_size:
        return None
    x0, y0, extent = _box(places)
    extent = extent or 1.0
    rows = written(places.select("id", "n", (F.col("x") - x0).alias("x"), (F.col("y") - y0).alias("y")), "locations")
    side = _first_side(rows, extent)
    cores = core_distances(rows, min_points - 1, side, extent)
    tree = written(spanning_tree(rows.select("id", "x", "y").join(cores, "id"), side, extent), "spanning-tree")
    held, nodes = hierarchy(rows, tree, min_size, extent * 1e-9)
    tops = highest(nodes, "node", "parent", F.col("own"))
    names = written(held.join(tops, "node").where("top is not null").select("point", "top"), "cluster-points")
    least = names.groupBy("top").agg(F.min("point").alias("cluster"))
    found = places.select("x", "y", "id").join(names.join(least, "top").select(F.col("point").alias("id"), "cluster"), "id").select("x", "y", "cluster")
    return placed.join(found, ["x", "y"], "left").select(F.col("key").alias(key), F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))
