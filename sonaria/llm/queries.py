"""The queries and oracle SQL of the operators for training text."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query name: (module, function)
_QUERIES = {
    "op1_simhash": ("simhash", "op1_query"),
    "op2_html_text": ("html", "op2_query"),
    "op3_media_columns": ("media", "op3_query"),
    "op4_multiset_hash": ("multiset", "op4_query"),
    "op5_packing": ("packing", "op5_query"),
    "op6_quality": ("quality", "op6_query"),
    "op7_line_spread": ("lines", "op7_query"),
    "op8_token_counts": ("tokens", "op8_query"),
    "op9_licenses": ("licenses", "op9_query"),
    "op10_mixing": ("mixing", "op10_query"),
    "op11_collocations": ("collocations", "op11_query"),
    "op12_fill_in_middle": ("fim", "op12_query"),
    "op13_byte_bpe": ("bpe", "op13_query"),
}


def _query(module: str, function: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: getattr(import_module(f"sonaria.llm.{module}"), function)(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(*where) for name, where in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """The SQL of those that SQL can express; the others are tested against brute force."""
    from sonaria.llm import collocations, fim, lines, mixing

    return {"op7_line_spread": lines.ORACLE_SQL, "op10_mixing": mixing.ORACLE_SQL, "op11_collocations": collocations.ORACLE_SQL, "op12_fill_in_middle": fim.ORACLE_SQL}
