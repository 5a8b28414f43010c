"""Registered queries: Spark callables ``(spark, data_dir) -> DataFrame`` and,
where SQL can express the operator, the DuckDB oracle SQL over the same
tables.  Columns are aliased identically on both sides; doubles are
rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(col) -> F.Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), 6)


def load_all() -> None:
    """Import every query module so the registry is filled."""
    from . import (q_text, q_vocab, q_topics, q_coherence, q_results, q_vectors,  # noqa: F401
                   q_time, q_models, q_lexicon, q_prep)
