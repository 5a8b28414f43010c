"""Time-sliced topics.

O1 equal-width binning follows pandas ``cut(x, bins=n)``: right-closed bins
over [min, max], the lowest value in bin 1, the first left edge lowered by
0.1% of the range; a bin is labelled by its left edge.  ``width_bucket`` is
left-closed and puts the maximum in bin n+1, so it is not used.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ctfidf


def equal_width_bins(df: DataFrame, value: str, n_bins: int, out: str = "bin") -> DataFrame:
    """O1: adds ``bin`` (1..n) and ``bin_start`` (left edge)."""
    rng = df.agg(F.min(value).cast("double").alias("_mn"), F.max(value).cast("double").alias("_mx"))
    j = df.crossJoin(F.broadcast(rng))               # one-row side
    width = (F.col("_mx") - F.col("_mn")) / n_bins
    b = F.least(F.lit(n_bins), F.greatest(F.lit(1), F.ceil(F.coalesce(
        F.try_divide(F.col(value).cast("double") - F.col("_mn"), width), F.lit(0.0))))).cast("long")
    start = F.when(b == 1, F.col("_mn") - (F.col("_mx") - F.col("_mn")) * 0.001).otherwise(F.col("_mn") + (b - 1) * width)
    return j.withColumn(out, b).withColumn(f"{out}_start", start).drop("_mn", "_mx")


def counts_per_bin(binned: DataFrame, n_bins: int, out: str = "bin") -> DataFrame:
    """O2: documents per bin in time order, empty bins included (count 0)."""
    spark = binned.sparkSession
    allb = spark.range(1, n_bins + 1).select(F.col("id").alias(out))
    c = binned.groupBy(out).agg(F.count(F.lit(1)).alias("n"))
    return allb.join(c, out, "left").select(out, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def topics_over_time(long: DataFrame, slice_col: str, topic_col: str, k: int = 5,
                     id_col: str = "doc_id") -> DataFrame:
    """O3: class TF-IDF per (slice, topic) with the global idf (no
    evolution or global tuning); top ``k`` words and the topic's document
    count in the slice: ``(time_slice, topic, frequency, rank, term, weight)``."""
    w = ctfidf.class_tfidf(long, [topic_col], scope_cols=[slice_col])
    top = ctfidf.top_words(w, [slice_col, topic_col], k)
    freq = long.groupBy(slice_col, topic_col).agg(F.count_distinct(id_col).alias("frequency"))
    return (top.join(freq, [slice_col, topic_col])
               .select(F.col(slice_col).alias("time_slice"), F.col(topic_col).alias("topic"),
                       F.col("frequency").cast("long").alias("frequency"), "rank", "term", "weight"))


def slice_topics(tot: DataFrame, noise_topic=None) -> DataFrame:
    """Per slice, topics ordered by frequency ascending (ties by topic),
    noise topic dropped; adds ``position``."""
    t = tot if noise_topic is None else tot.filter(F.col("topic") != F.lit(noise_topic))
    topics = t.select("time_slice", "topic", "frequency").distinct()
    w = Window.partitionBy("time_slice").orderBy("frequency", "topic")
    pos = topics.withColumn("position", (F.row_number().over(w) - 1).cast("long"))
    return t.join(pos.drop("frequency"), ["time_slice", "topic"])


def repair_slices(tot: DataFrame, corpus_long: DataFrame) -> DataFrame:
    """Out-of-vocabulary repair within every slice."""
    return ctfidf.repair_oov(tot, corpus_long)
