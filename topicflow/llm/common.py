"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from ..sources.tables import read_table  # noqa: F401


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared ``spark.checkpoint.dir``."""
    return shared_path(spark, f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is
    cut, and a lost executor costs no recomputation.  ``by`` names a column of
    few values; a filter on it reads only its folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it inside ``body`` (a lambda variable is
    evaluated once, however often the body names it)."""
    return F.transform(F.array(value), body)[0]


def text_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Identity of a row: rows equal in id and text are one document."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"))


def boxed(docs: DataFrame, **more: Column) -> DataFrame:
    """All columns of ``docs`` in one column ``row``, beside ``more``: no name of the input meets ours."""
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    return docs.select(row.alias("row"), *[v.alias(k) for k, v in more.items()])


def unboxed(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again."""
    return found.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
