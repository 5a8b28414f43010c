"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .common import read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, d: str) -> DataFrame:
    from .toxicity import toxicity
    return toxicity(read_table(spark, d, "documents"), read_table(spark, d, "labels"))


@query("op6_simhash")
def op6_simhash(spark: SparkSession, d: str) -> DataFrame:
    from .simhash import simhash
    return simhash(read_table(spark, d, "documents"))


@query("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    from .line_dedup import line_dedup
    return line_dedup(read_table(spark, d, "documents"))


@query("op5_decontamination", sql.decontamination())
def op5_decontamination(spark: SparkSession, d: str) -> DataFrame:
    from .decontam import decontaminate
    return decontaminate(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"))


@query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    from .bpe import digests
    return digests(read_table(spark, d, "documents"))


@query("op9_token_files")
def op9_token_files(spark: SparkSession, d: str) -> DataFrame:
    from .tokens_out import token_files
    return token_files(read_table(spark, d, "documents"))


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, d: str) -> DataFrame:
    from .token_counts import token_counts
    return token_counts(read_table(spark, d, "documents"))


@query("op4_url_filter")
def op4_url_filter(spark: SparkSession, d: str) -> DataFrame:
    from .url_filter import judge
    return judge(read_table(spark, d, "pages"))


@query("op2_quality_rules", sql.quality())
def op2_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    from .quality import quality
    return quality(read_table(spark, d, "documents"))


@query("op8_html_extraction")
def op8_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    from .extract import main_text
    return main_text(read_table(spark, d, "pages"))


@query("op11_warc_index", sql.warc())
def op11_warc_index(spark: SparkSession, d: str) -> DataFrame:
    from .warc import captures
    return captures(read_table(spark, d, "pages"))


@query("op12_periodic_runs", sql.runs())
def op12_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    from .runs import digests, periodic_runs, planted
    return digests(periodic_runs(planted(read_table(spark, d, "documents"))))


@query("op13_ranked_search", sql.search())
def op13_ranked_search(spark: SparkSession, d: str) -> DataFrame:
    from .search import ranked
    return ranked(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"))
