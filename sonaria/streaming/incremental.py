"""Streams over the append-only trace, and incremental upserts of features."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaria.operators.relational import newest
from sonaria.sources.shared import delete_path, file_system


def trace_windows(events: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Calls, failures and mean time per tool and tumbling window; rows later than ``late`` are dropped."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    made = rows.agg(F.count("*").alias("calls"), F.sum("value").alias("total"))
    return made.select(F.col("window.start").alias("start"), "event_type", "calls", "total")


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: calls with no gap longer than ``gap`` between them."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return rows.agg(F.count("*").alias("calls")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "calls")


def snapshots(spark: SparkSession, path: str) -> list[str]:
    """The whole snapshots of a table under ``path``, the oldest first."""
    store, folder = file_system(spark, path)
    if not store.exists(folder):
        return []
    names = [s.getPath().getName() for s in store.listStatus(folder) if s.isDirectory() and s.getPath().getName().startswith("v=")]
    return sorted(n for n in names if store.exists(file_system(spark, f"{path}/{n}/_SUCCESS")[1]))


def newest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The table as the last whole batch left it."""
    return spark.read.parquet(f"{path}/{snapshots(spark, path)[-1]}")


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, kept: int = 2):
    """Keep the newest row per key of a stream in snapshots under ``path``.

    Each batch writes the next snapshot from the last whole one, whichever checkpoint wrote that; a
    snapshot's name tells its checkpoint and batch, so a batch that is run again is not added twice,
    and one that was cut short is written anew. All but the last ``kept`` snapshots are deleted.
    """
    spark: SparkSession = stream.sparkSession
    own = hashlib.md5(checkpoint.encode()).hexdigest()[:8]

    def merge(batch: DataFrame, number: int) -> None:
        found = snapshots(spark, path)
        if any(n.endswith(f"-{own}-{number:010}") for n in found):
            return
        turn = int(found[-1][2:14]) + 1 if found else 0
        rows = spark.read.schema(batch.schema).parquet(f"{path}/{found[-1]}").unionByName(batch) if found else batch
        newest(rows, keys, [F.desc(order)]).write.mode("overwrite").parquet(f"{path}/v={turn:012}-{own}-{number:010}")
        for name in found[: max(0, len(found) + 1 - kept)]:
            delete_path(spark, f"{path}/{name}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
