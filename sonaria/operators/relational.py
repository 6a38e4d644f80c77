"""Relational operators that more than one query uses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonaria.sources.shared import written


def longest_prefix(rows: DataFrame, path: str, owners: DataFrame, prefix: str, sep: str = "/") -> DataFrame:
    """Rows with the columns of the owner whose path is theirs or the longest above it.

    Every row lists its ancestors and meets the owners by equality, so owners need not be few: no
    row is compared with all owners.
    """
    parts = F.split(path, f"\\Q{sep}\\E")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), sep))
    key = [F.col(c) for c in rows.columns]
    met = rows.withColumn("__up", F.explode(ups)).join(owners.withColumnRenamed(prefix, "__up"), "__up")
    rest = [c for c in owners.columns if c != prefix]
    best = F.max_by(F.struct(*rest), F.length("__up")).alias("__best")
    return met.groupBy(*key).agg(best).select(*key, *[F.col(f"__best.{c}").alias(c) for c in rest])


def pair_counts(rows: DataFrame, owner: str, name: str) -> DataFrame:
    """a < b and the number of distinct names they share, for all owners that share one.

    Owners of a name meet by equality and partial counts are merged before the shuffle; a name
    that very many owners have is split over tasks as a skewed join.
    """
    own = rows.select(F.col(owner).alias("o"), F.col(name).alias("n")).where(F.col(name).isNotNull()).distinct()
    left, right = own.select(F.col("o").alias("a"), "n"), own.select(F.col("o").alias("b"), "n")
    return left.join(right, "n").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def newest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key, and the others added."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def zero_filled(rows: DataFrame, key: str, members: list[str], sums: dict[str, Column]) -> DataFrame:
    """Aggregates by ``key`` with zeros for members without rows; unknown members stay."""
    spark = rows.sparkSession
    made = rows.groupBy(key).agg(*[v.alias(k) for k, v in sums.items()])
    dimension = spark.createDataFrame([(m,) for m in members], f"{key} string")
    return dimension.join(made, key, "full").select(key, *[F.coalesce(k, F.lit(0)).alias(k) for k in sums])


def global_ranks(rows: DataFrame, value: str, group: list[str] | None = None, part_rows: int = 200_000) -> DataFrame:
    """Adds ``less``, the number of rows of the group with a smaller value, and ``n``, the number of
    its rows with a value; both are null for a row without one. Groups are few (names of dimensions).

    Counts of equal values are summed in ranges of values, ranges are totalled, and each value
    takes what lies before it in its range and before its range: no window holds all rows.
    """
    group = group or []
    known = rows.where(F.col(value).isNotNull())
    parts = max(8, min(4096, known.count() // part_rows))
    counts = known.groupBy(*group, value).agg(F.count("*").alias("__c"))
    cuts = known.groupBy(*group).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], max(10_000, 20 * parts)).alias("__cuts"))
    split = (counts.join(F.broadcast(cuts), group) if group else counts.crossJoin(F.broadcast(cuts))).withColumn("__part", F.size(F.filter("__cuts", lambda x: x <= F.col(value)))).drop("__cuts")  # a row a group
    before = lambda *keys: Window.partitionBy(*(group or [F.lit(0)]), *keys)
    inner = F.sum("__c").over(before("__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    totals = split.groupBy(*group, "__part").agg(F.sum("__c").alias("__t"))  # ``parts`` rows a group
    ahead = F.sum("__t").over(before().orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select(*group, "__part", F.coalesce(ahead, F.lit(0)).alias("__start"), F.sum("__t").over(before()).alias("n"))
    ranked = split.withColumn("__in", F.coalesce(inner, F.lit(0))).join(F.broadcast(starts), [*group, "__part"])
    return rows.join(ranked.select(*group, value, (F.col("__start") + F.col("__in")).alias("less"), "n"), [*group, value], "left")


def first_rows(rows: DataFrame, keys: list[str], order: str, most: int, shards: int = 16) -> DataFrame:
    """The first ``most`` rows of each key: of each shard of a key first, so that no task holds a key."""
    shard = F.pmod(F.xxhash64(order), F.lit(shards))
    place = lambda *more: F.row_number().over(Window.partitionBy(*keys, *more).orderBy(order))
    few = rows.withColumn("__shard", shard).withColumn("__rn", place("__shard")).where(F.col("__rn") <= most)
    return few.withColumn("__rn", place()).where(F.col("__rn") <= most).drop("__shard", "__rn")


def spread_places(rows: DataFrame, key: str, order: str, label: str = "place") -> DataFrame:
    """Adds the place of each row within its key, from 1, in the order of ``order``, which no two rows of a key share.

    Rows are sorted in ranges; a range's places start after the key's rows in the ranges before it.
    """
    ranged = written(rows.repartitionByRange(key, order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(key, "__part").agg(F.count("*").alias("__n"))  # a row for each key and range
    before = F.sum("__n").over(Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(key, "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy(key, "__part").orderBy(order))
    return ranged.withColumn("__inner", inner).join(starts, [key, "__part"]).withColumn(label, F.col("__inner") + F.col("__before")).drop("__part", "__inner", "__before")


def nested_blocks(rows: DataFrame, key: str, order: str, item: Column, size: int = 100, label: str = "items") -> DataFrame:
    """key, block (from 0), ``label``: the items of each key in the order of ``order``, which no two rows of a key
    share, in arrays of at most ``size``; the arrays of a key, one after the other, hold all of them."""
    placed = spread_places(rows.select(key, F.col(order).alias("__o"), item.alias("__i")), key, "__o")
    parts = placed.groupBy(key, F.floor((F.col("place") - 1) / size).alias("block"))
    sorted_ = F.array_sort(F.collect_list(F.struct("place", "__i")))  # ``size`` rows
    return parts.agg(F.transform(sorted_, lambda x: x["__i"]).alias(label))


def spread_sums(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds ``__before``, the sum of ``value`` over the key's rows before this one, and ``__place``, its place from 1,
    in the order of ``order``, which no two rows of a key share. Ranges as in ``spread_places``."""
    ranged = written(rows.repartitionByRange(key, order).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(key, "__part").agg(F.sum(value).alias("__s"), F.count("*").alias("__n"))  # a row for each key and range
    above = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(key, "__part", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}0") for c in ("__s", "__n")])
    inside = Window.partitionBy(key, "__part").orderBy(order)
    inner = ranged.select("*", F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__si"), F.row_number().over(inside).alias("__ni"))
    met = inner.join(starts, [key, "__part"])
    return met.select(*rows.columns, (F.col("__si") + F.col("__s0")).alias("__before"), (F.col("__ni") + F.col("__n0")).alias("__place"))


def numbered(rows: DataFrame, order: str, label: str, above: int = 0) -> DataFrame:
    """Adds numbers above ``above``, ascending with ``order``, which no two rows share."""
    placed = spread_places(rows.withColumn("__all", F.lit(0)), "__all", order, label)
    return placed.withColumn(label, (F.col(label) + above).cast("long")).drop("__all")


def similar_pairs(rows: DataFrame, owner: str, name: str, least: float) -> DataFrame:
    """a < b, shared, ka, kb for all owners whose sets of names have a Jaccard similarity of ``least`` or more.

    Owners meet by the rarest of their names only: of k names in ascending order of frequency, two sets
    that are alike share one among the first k - ceil(least * k) + 1 of each. Sizes are compared before
    the names of candidates are intersected, so a name that all owners have makes no pairs.
    """
    own = rows.select(F.col(owner).alias("o"), F.col(name).alias("n")).where(F.col(name).isNotNull()).distinct()
    rare = own.join(own.groupBy("n").agg(F.count("*").alias("f")), "n")
    sets = rare.groupBy("o").agg(F.array_sort(F.collect_list(F.struct("f", "n"))).alias("s")).select("o", F.transform("s", lambda x: x["n"]).alias("s"), F.size("s").cast("long").alias("k"))
    prefix = F.slice("s", F.lit(1), (F.col("k") - F.ceil(least * F.col("k") - 1e-9) + 1).cast("int"))
    heads = sets.select("o", "k", F.explode(prefix).alias("n"))
    side = lambda x: heads.select(F.col("o").alias(x), F.col("k").alias(f"k{x}"), "n")
    met = side("a").join(side("b"), "n").where("a < b").where(F.least("ka", "kb") >= least * F.greatest("ka", "kb") - 1e-9).select("a", "b").distinct()
    both = lambda x: sets.select(F.col("o").alias(x), F.col("s").alias(f"s{x}"), F.col("k").alias(f"k{x}"))
    pairs = met.join(both("a"), "a").join(both("b"), "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")).cast("long"))
    return pairs.where(F.col("shared") >= least * (F.col("ka") + F.col("kb") - F.col("shared")) - 1e-9).select("a", "b", "shared", "ka", "kb")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
