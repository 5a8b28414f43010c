"""Incremental corpus preparation with Structured Streaming.

New document files (Parquet ``doc_id, text[, ts]``) arriving in a folder
are cleaned and tokenised with the same Column expressions as the batch
path and appended to a Parquet corpus; an optional event-time view keeps
per-window term counts (watermarked) for topics over time.  State and
progress live under the cluster's checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stopwords
from ..functions.text import loader_normalise
from ..functions.tokens import remove_words, vocab_tokens
from ..session import shared_path

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])


def tokenised_stream(spark: SparkSession, source_dir: str, schema: T.StructType = DOC_SCHEMA) -> DataFrame:
    docs = spark.readStream.schema(schema).parquet(source_dir)
    docs = docs.filter(F.col("text").isNotNull() & (F.length("text") > 2))
    toks = remove_words(vocab_tokens(loader_normalise("text")), stopwords.stopwords("en"))
    return docs.select("doc_id", "ts", toks.alias("tokens"))


def windowed_term_counts(tokens: DataFrame, window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """Term counts per event-time window; late rows beyond the watermark are dropped."""
    long = tokens.select("ts", F.explode_outer("tokens").alias("term")).filter(F.col("term").isNotNull())
    return (long.withWatermark("ts", watermark)
                .groupBy(F.window("ts", window).alias("w"), "term").agg(F.count(F.lit(1)).alias("n"))
                .select(F.col("w.start").alias("window_start"), "term", "n"))


def start_corpus_sink(spark: SparkSession, source_dir: str, out_dir: str, name: str = "corpus_stream",
                      trigger_once: bool = True):
    """Append tokenised documents to ``out_dir`` (exactly-once file sink)."""
    q = (tokenised_stream(spark, source_dir).writeStream.format("parquet")
         .option("path", out_dir).option("checkpointLocation", shared_path(spark, f"{name}-checkpoint"))
         .outputMode("append"))
    q = q.trigger(availableNow=True) if trigger_once else q
    return q.start()
