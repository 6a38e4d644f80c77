"""Named queries over the driver's tables and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from sonaria.sources.views import oracle, view

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("browse", "joins", "rollups", "ordering", "scalar", "vector", "retrieval", "duplicates", "checks", "ingest", "audio")


class Catalog:
    """The catalog's views and the driver's tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return view(self.spark, self.folder, name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, views: str = "", sql: str | None = None):
    """Register a function of a Catalog as a query, with its oracle over ``views``."""

    def register(function: Callable[[Catalog], DataFrame]):
        _QUERIES[name] = lambda spark, folder: function(Catalog(spark, folder))
        if sql:
            _ORACLES[name] = oracle(views, sql)
        return function

    return register


def _load() -> None:
    for m in _MODULES:
        import_module(f"sonaria.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
