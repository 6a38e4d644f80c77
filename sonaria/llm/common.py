"""Shared helpers: tables written to the cluster's shared folder and column plumbing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonaria.sources.shared import delete_path, new_path, written

__all__ = ["BROADCAST_ROWS", "Written", "new_path", "small", "spread_join", "table", "unfolded", "written"]


class Written:
    """A DataFrame written as Parquet to the shared folder that can be dropped when it is used up."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, label)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        delete_path(self.spark, self.path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables up to this number of rows (a few longs each) are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000


def small(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` (of a written table), marked for a broadcast only where a count shows that they are few."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def unfolded(rows: DataFrame) -> DataFrame:
    """``rows`` that an explode has made, marked for joins by shuffle: the planner takes their size from
    before the explode and would send many times its broadcast limit to the driver."""
    return rows.hint("merge")


def spread_join(rows: DataFrame, other: DataFrame, keys: list[str], salt: Column, counted: DataFrame | None = None, n: int | None = None, parts: int = 1000) -> DataFrame:
    """``rows`` joined with ``other``, which has one row for each of ``keys``.

    A key with more than 1/``parts`` of the rows is dealt out by ``salt`` to as many places as it has
    such shares, and its row of ``other`` is copied to each; there are ``parts`` such keys at most.
    ``counted`` may name the same keys with fewer columns, and ``n`` their number.
    """
    counted = rows if counted is None else counted
    counts = counted.groupBy(*keys).agg(F.count("*").alias("__n"))
    least = max(200, (counted.count() if n is None else n) // parts)
    heavy = counts.where(F.col("__n") > least).select(*keys, F.ceil(F.col("__n") / least).cast("int").alias("__salts")).collect()  # ``parts`` rows
    if not heavy:
        return rows.join(other, keys)
    shares = F.broadcast(rows.sparkSession.createDataFrame(heavy, reduce(lambda t, k: t.add(rows.schema[k]), keys, T.StructType()).add("__salts", T.IntegerType())))
    dealt = rows.join(shares, keys, "left").withColumn("__salt", F.pmod(salt, F.coalesce("__salts", F.lit(1)))).drop("__salts")
    copied = other.join(shares, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return dealt.join(copied, [*keys, "__salt"]).drop("__salt")
