"""Filters, projections and sampling (P1, P2, P4, P5, P7, P9-P12) and a
distributed dense row index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import loader_normalise
from ..session import pinned


def min_length(df: DataFrame, text: str = "text", more_than: int = 2) -> DataFrame:
    """Keep texts longer than ``more_than`` characters."""
    return df.filter(F.length(text) > more_than)


def strings_only(df: DataFrame, text: str = "text") -> DataFrame:
    """Drop missing texts (non-strings cannot exist in a typed column)."""
    return df.filter(F.col(text).isNotNull())


def loader_clean(df: DataFrame, text: str = "text", more_than: int | None = 2) -> DataFrame:
    """P1 + P2 + P3 as every named loader applies them."""
    out = strings_only(df, text)
    if more_than is not None:
        out = min_length(out, text, more_than)
    return out.withColumn(text, loader_normalise(text))


def dense_index(df: DataFrame, name: str = "doc_index") -> DataFrame:
    """0-based position of every row in the current partition order.

    Like ``zipWithIndex`` but DataFrame-only: per-partition counts (one row
    per partition) give offsets; no global window, no single-task sort.
    Call on an ordered frame (``orderBy`` range-partitions) for a rank.
    The rows are written with their partition's number, as the counts and the
    rows of two plans may be partitioned differently (each draws its own bounds
    and merges partitions by its own sizes).
    """
    tagged = pinned(df.withColumn("_pid", F.spark_partition_id())
                      .withColumn("_mid", F.monotonically_increasing_id()))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    idx = F.col("_off") + F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (tagged.join(F.broadcast(offsets), "_pid")
                  .withColumn(name, idx.cast("long"))
                  .drop("_pid", "_mid", "_off"))


def hash_key(id_col: str, seed: int):
    """Seeded sampling key; md5 so the SQL oracle can reproduce it."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def exact_sample(df: DataFrame, n: int, id_col: str = "doc_id", seed: int = 0,
                 hex_digits: int = 4) -> DataFrame:
    """Exactly ``n`` rows without replacement, seeded, original order kept.

    Rows are ranked by a seeded md5 key.  A per-bucket histogram on the
    key's first hex digits (16**hex_digits rows) finds the bucket holding the
    n-th key; every row of lower buckets is taken, and only that one
    bucket (about N/buckets rows) is ordered to take the rest.  No global
    sort and no n-row top-k in one task.
    """
    digits = hex_digits
    keyed = df.withColumn("_h", hash_key(id_col, seed)).withColumn(
        "_b", F.conv(F.substring("_h", 1, digits), 16, 10).cast("long"))
    hist = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.withColumn("_cum", F.sum("_c").over(w)).withColumn("_before", F.col("_cum") - F.col("_c"))
    cut = cum.filter((F.col("_cum") >= n) & (F.col("_before") < n)).select(
        F.col("_b").alias("_cut_b"), (F.lit(n) - F.col("_before")).alias("_need"))
    total = hist.agg(F.sum("_c").alias("_tot"))
    # when n >= row count no bucket crosses n: take everything
    cut = cut.unionByName(total.filter(F.col("_tot") < n).select(
        F.lit(1 << 62).cast("long").alias("_cut_b"), F.lit(0).cast("long").alias("_need")))
    j = keyed.crossJoin(F.broadcast(cut))           # one-row side
    below = j.filter(F.col("_b") < F.col("_cut_b"))
    edge = j.filter(F.col("_b") == F.col("_cut_b"))
    rk = Window.partitionBy("_b").orderBy("_h")
    edge = edge.withColumn("_r", F.row_number().over(rk)).filter(F.col("_r") <= F.col("_need")).drop("_r")
    return below.unionByName(edge).drop("_h", "_b", "_cut_b", "_need")


def sample_with_replacement(df: DataFrame, k: int, seed: int = 0, id_col: str = "doc_id",
                            order_col: str | None = None) -> DataFrame:
    """P5: ``k`` draws of row positions in [0, n) with replacement.

    Draw i picks position ``pmod(xxhash64(seed, i), n)``; positions come
    from a distributed dense index over ``order_col`` (default ``id_col``).
    A row drawn twice appears twice (column ``draw``).
    """
    spark = df.sparkSession
    indexed = dense_index(df.orderBy(order_col or id_col), "_pos")
    n = indexed.agg(F.count(F.lit(1)).alias("_n"))
    draws = (spark.range(k).withColumnRenamed("id", "draw").crossJoin(F.broadcast(n))
             .select("draw", F.pmod(F.xxhash64(F.lit(seed), F.col("draw")), F.col("_n")).alias("_pos")))
    return draws.join(indexed, "_pos").drop("_pos")


def drop_empty(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Drop documents whose token list is null or empty."""
    return df.filter(F.col(tokens).isNotNull() & (F.size(tokens) > 0))


def isin_filter(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Rows whose ``col`` is one of ``values``."""
    return df.filter(F.col(col).isin(list(values)))


def exclude(df: DataFrame, col: str, value) -> DataFrame:
    """P10: drop one series."""
    return df.filter(F.col(col) != F.lit(value))


def top_k_cut(topics: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """Keep the first ``k`` words of every topic (0-based ``rank``)."""
    return topics.filter(F.col(rank) < k)


def require_valid_ids(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` itself, or a ValueError that names the violation."""
    kinds = dict(df.dtypes)
    if kinds[text] != "string":
        raise ValueError(f"documents must be strings, not {kinds[text]}")
    if kinds[id_col] not in ("string", "tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"document ids must be strings or integers, not {kinds[id_col]}")
    row = id_validation(df, id_col, text).first()
    if not row["valid"]:
        raise ValueError(f"document ids must be unique and present, texts present: {row.asDict()}")
    return df


def id_validation(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One summary row; valid when ids are unique, present, and texts are strings."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(F.col(id_col)).alias("n_distinct_ids"),
        F.sum(F.when(F.col(id_col).isNull(), 1).otherwise(0)).cast("long").alias("n_null_ids"),
        F.sum(F.when(F.col(text).isNull(), 1).otherwise(0)).cast("long").alias("n_null_texts"),
    ).withColumn("valid", (F.col("n_rows") == F.col("n_distinct_ids")) & (F.col("n_null_ids") == 0)
                 & (F.col("n_null_texts") == 0))
