"""Standard corpora derived from the document table.

``raw_corpus``        P1-P3 loader cleaning, vocabulary token pattern,
                      English stop words removed: (doc_id, lang, source, tokens)
``restricted_corpus`` V1 document-frequency vocabulary, V4 restriction
``source_topics``     class TF-IDF of the restricted corpus by ``source``
                      (20 labelled classes stand in for a fitted model), top 10
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stopwords
from ..functions.tokens import remove_words, vocab_tokens
from ..operators import ctfidf, filters, vocab
from ..session import pinned, materialise, spread
from ..sources.tables import read_table

TOPK = 10


_MEMO: dict = {}


def clear_memo() -> None:
    for df in _MEMO.values():
        try:
            df.unpersist()
        except Exception:
            pass
    _MEMO.clear()


def _memo(spark, key, build):
    k = (id(spark), key)
    if k not in _MEMO:
        _MEMO[k] = materialise(build())
    return _MEMO[k]


def documents(spark: SparkSession, data_dir: str) -> DataFrame:
    docs = read_table(spark, data_dir, "documents").select("doc_id", "text", "lang", "source")
    return spread(docs)


def tokenise(df: DataFrame, keep=()) -> DataFrame:
    """Loader cleaning, vocabulary token pattern, English stop words out."""
    docs = filters.loader_clean(df)
    toks = remove_words(vocab_tokens("text"), stopwords.stopwords("en"))
    return docs.select("doc_id", *keep, toks.alias("tokens"))


def raw_corpus(spark: SparkSession, data_dir: str) -> DataFrame:
    return tokenise(documents(spark, data_dir), ("lang", "source"))


def benchmark_corpus(spark: SparkSession, data_dir: str) -> DataFrame:
    b = read_table(spark, data_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return tokenise(b)


def conversation_corpus(spark: SparkSession, data_dir: str) -> DataFrame:
    c = read_table(spark, data_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "role", "text")
    return tokenise(c, ("role",))


def documents_by_id(spark: SparkSession, data_dir: str) -> DataFrame:
    """The documents dealt by id: the text travels once, and what is grouped by document later stays in place."""
    return read_table(spark, data_dir, "documents").select("doc_id", "text", "lang", "source").repartition("doc_id")


def build_restricted(raw: DataFrame) -> DataFrame:
    """V1 bounds + V4 restriction; tokens joined by one space (none holds any)."""
    kept = vocab.restrict_by_df_bounds(raw, keep=("lang", "source"))
    return kept.withColumn("tokens", F.array_join("tokens", " "))


def restricted_corpus(spark: SparkSession, data_dir: str) -> DataFrame:
    """Shared, persisted once per session and folder (several branches reuse it).

    Kept as text, a third of the size of arrays, in the layout by document, and
    filled by one action, so that later plans know both.
    """
    def build():
        kept = materialise(build_restricted(tokenise(documents_by_id(spark, data_dir), ("lang", "source"))))
        kept.count()
        return kept
    return _memo(spark, ("restricted", data_dir), build).withColumn("tokens", F.split("tokens", " "))


def restricted_long(spark: SparkSession, data_dir: str) -> DataFrame:
    """Long form ``(doc_id, lang, source, n, pos, term)`` of the kept corpus; not kept itself, as its rows take several times the text."""
    rc = restricted_corpus(spark, data_dir).withColumn("n", F.size("tokens"))
    return vocab.explode_tokens(rc, keep=("lang", "source", "n"))


def class_topics(long: DataFrame, class_col: str, k: int = TOPK) -> DataFrame:
    w = ctfidf.class_tfidf(long, [class_col])
    top = ctfidf.top_words(w, [class_col], k)
    return top.select(F.col(class_col).alias("topic"), "rank", "term", "weight")


def source_topics(spark: SparkSession, data_dir: str, k: int = TOPK) -> DataFrame:
    """Bounded (classes x k rows); persisted because scoring joins it many times."""
    k_ = (id(spark), ("source_topics", data_dir, k))
    if k_ not in _MEMO:
        _MEMO[k_] = pinned(class_topics(restricted_long(spark, data_dir), "source", k))
    return _MEMO[k_]
