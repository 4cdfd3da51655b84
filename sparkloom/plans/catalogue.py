"""Every query over the driver's tables, by name, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import run_queries, score_queries, sink_queries, split_queries, text_queries

_MODULES = (split_queries, text_queries, score_queries, run_queries, sink_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
