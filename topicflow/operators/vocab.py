"""Vocabulary and document-term aggregations.

Token tables come in two shapes: a document table with an ``ARRAY<STRING>``
column, or the long table ``(doc_id, pos, term)``.  Aggregations explode
and group (map-side partial aggregation); nothing is collected unless a
size bound is given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, pinned
from .filters import dense_index

LISTED = 1_000_000       # rows of a term table that Spark may copy to every executor


def explode_tokens(df: DataFrame, id_cols: Sequence[str] = ("doc_id",), tokens: str = "tokens",
                   keep: Sequence[str] = ()) -> DataFrame:
    """Long table ``(*id_cols, pos, term)`` with 0-based positions."""
    cols = [F.col(c) for c in (*id_cols, *keep)]
    return df.select(*cols, F.posexplode_outer(tokens).alias("pos", "term")).filter(F.col("term").isNotNull())


def doc_freq_vocabulary(df: DataFrame, tokens: str = "tokens", min_df: float = 0.00002,
                        max_df: float = 0.99) -> DataFrame:
    """V1: terms with ``min_df*n <= df <= max_df*n`` (n = documents), ``(term, df)``."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    dfreq = (distinct_terms_per_doc(df, tokens)
               .groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    return (dfreq.crossJoin(F.broadcast(n))          # one-row side
                 .filter((F.col("df") >= F.lit(min_df) * F.col("_n"))
                         & (F.col("df") <= F.lit(max_df) * F.col("_n")))
                 .select("term", F.col("df").cast("long").alias("df")))


def explode_terms(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """One row per token.  ``explode_outer`` + null filter: a plain explode
    makes the optimizer infer ``size(tokens) > 0`` and push it (and the
    whole tokeniser) below the preceding repartition."""
    return df.select(F.explode_outer(tokens).alias("term")).filter(F.col("term").isNotNull())


def distinct_terms_per_doc(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    return explode_terms(df.select(F.array_distinct(tokens).alias("_d")), "_d")


def term_counts(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """V7: corpus count per term, ``(term, n)``."""
    return explode_terms(df, tokens).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def frequency_capped_vocabulary(df: DataFrame, tokens: str = "tokens", top: int = 2000) -> DataFrame:
    """V2: the ``top`` most frequent terms; ties by term (a bounded top-k)."""
    return term_counts(df, tokens).orderBy(F.desc("n"), F.asc("term")).limit(top)


def min_count_vocabulary(df: DataFrame, tokens: str = "tokens", min_count: int = 50) -> DataFrame:
    """V3: terms counted strictly more than ``min_count`` times."""
    return term_counts(df, tokens).filter(F.col("n") > min_count)


def restrict_to_vocabulary(df: DataFrame, vocab: DataFrame, id_col: str = "doc_id",
                           tokens: str = "tokens", keep: Sequence[str] = ()) -> DataFrame:
    """V4: keep in-vocabulary tokens in order (duplicates kept); emptied
    documents disappear.  Explode -> semi-join (``listed``) -> regroup per
    document, without a shuffle where the rows lie by ``id_col``.
    """
    long = explode_tokens(df, (id_col,), tokens, keep)
    return _regrouped(long.join(listed(vocab.select("term")), "term", "left_semi"), id_col, tokens, keep)


def _regrouped(long: DataFrame, id_col: str, tokens: str, keep: Sequence[str]) -> DataFrame:
    grouped = long.groupBy(id_col, *keep).agg(
        F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("_pt"))
    return grouped.select(id_col, *keep, F.transform("_pt", lambda x: x["term"]).alias(tokens))


def listed(terms: DataFrame) -> DataFrame:
    """A table of terms or pairs, written once; up to ``LISTED`` of them go to the
    tokens, which then need no shuffle.  A larger one is left to Spark's join."""
    out = pinned(terms)
    return F.broadcast(out) if out.count() <= LISTED else out


def restrict_by_df_bounds(df: DataFrame, min_df: float = 0.00002, max_df: float = 0.99,
                          tokens: str = "tokens", id_col: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """V1 + V4: tokens of terms inside the document-frequency bounds.

    A lower bound of one document or less lets every term in, and the few above
    the upper one are taken out.  Otherwise at most (distinct terms a document) /
    ``min_df`` terms are inside, however many documents there are.  Rows that
    already lie by ``id_col`` are not shuffled again.
    """
    n = df.count()
    dfreq = distinct_terms_per_doc(df, tokens).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    least, most = min_df * n, max_df * n
    if least > 1:
        return restrict_to_vocabulary(df, dfreq.where((F.col("df") >= least) & (F.col("df") <= most)), id_col, tokens, keep)
    frequent = listed(dfreq.where(F.col("df") > most).select("term"))
    return _regrouped(explode_tokens(df, (id_col,), tokens, keep).join(frequent, "term", "left_anti"), id_col, tokens, keep)


def dictionary(vocab: DataFrame, term: str = "term") -> DataFrame:
    """V5: dense ``term_id`` in term order (range-partitioned sort + offsets)."""
    return dense_index(vocab.select(term).distinct().orderBy(term), "term_id").select(term, "term_id")


def bag_of_words(long: DataFrame, dict_df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """V6: ``(doc_id, term_id, n)``."""
    counts = long.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("n"))     # before the join: hot terms shrink
    return counts.join(dict_df, "term").select(id_col, "term_id", "n")


def tfidf(long: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """V8: smoothed TF-IDF with L2 row normalisation.

    ``tf * (ln((1+n)/(1+df)) + 1)``; n = documents, df = documents with the term.
    """
    tf = materialise(long.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf")))
    n = tf.select(id_col).distinct().agg(F.count(F.lit(1)).alias("_n"))
    dfreq = tf.groupBy("term").agg(F.count(F.lit(1)).alias("_df")).crossJoin(n)
    idf = listed(dfreq.select("term", (F.log((F.col("_n") + 1) / (F.col("_df") + 1)) + 1).alias("_idf")))
    w = tf.join(idf, "term").withColumn("_raw", F.col("tf") * F.col("_idf"))
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(id_col)))
    return w.select(id_col, "term", F.col("tf").cast("long").alias("tf"), (F.col("_raw") / norm).alias("weight"))


def metadata(all_docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """V9: total documents and vocabulary length as one row."""
    return (all_docs.agg(F.count(F.lit(1)).alias("total_documents"))
                    .crossJoin(vocab.agg(F.count(F.lit(1)).alias("vocabulary_length"))))


def dataset_size(corpus: DataFrame) -> DataFrame:
    """Corpus length."""
    return corpus.agg(F.count(F.lit(1)).alias("dataset_size"))
