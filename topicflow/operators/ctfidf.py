"""Class TF-IDF, top words per topic and out-of-vocabulary repair.

Class TF-IDF (Grootendorst 2022): ``tf(t,c) * ln(1 + A / f(t))`` with tf
L1-normalised per class, f(t) the term's count over all classes and A the
whole-number mean of tokens per class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def class_tfidf(long: DataFrame, class_cols: Sequence[str], term: str = "term",
                scope_cols: Sequence[str] = ()) -> DataFrame:
    """``(*scope, *class, term, n, weight)`` from a long token table.

    ``scope_cols`` (e.g. a time slice) split the classes while ``f(t)`` and
    ``A`` stay global, as for topics over time without global tuning.
    Partial aggregation happens before every shuffle; class totals are one
    row per class and the global constant is one row.
    """
    keys = [*scope_cols, *class_cols]
    counts = materialise(long.groupBy(*keys, term).agg(F.count(F.lit(1)).alias("n")))
    return class_tfidf_from_counts(counts, class_cols, term, scope_cols)


def class_tfidf_from_counts(counts: DataFrame, class_cols: Sequence[str], term: str = "term",
                            scope_cols: Sequence[str] = (), global_counts: DataFrame | None = None
                            ) -> DataFrame:
    keys = [*scope_cols, *class_cols]
    tot = counts.groupBy(*keys).agg(F.sum("n").alias("_tot"))
    base = global_counts if global_counts is not None else counts
    f = base.groupBy(term).agg(F.sum("n").alias("_f"))
    if not scope_cols and global_counts is None:
        per_class = tot.withColumnRenamed("_tot", "_ct")        # same aggregate, no second pass
    else:
        per_class = base.groupBy(*class_cols).agg(F.sum("n").alias("_ct"))
    avg = per_class.agg(F.floor(F.avg("_ct")).alias("_A"))
    w = (counts.join(tot, keys).join(f, term).crossJoin(F.broadcast(avg))
               .withColumn("weight", (F.col("n") / F.col("_tot")) * F.log(F.lit(1.0) + F.col("_A") / F.col("_f"))))
    return w.select(*keys, term, F.col("n").cast("long").alias("n"), "weight")


def top_words(weights: DataFrame, group_cols: Sequence[str], k: int = 10, term: str = "term",
              score: str = "weight") -> DataFrame:
    """Best ``k`` terms per group, ties by term; adds 0-based ``rank``.

    ``row_number() <= k`` lets Spark insert a partial WindowGroupLimit before
    the shuffle, so a huge topic ships at most k rows per map partition.
    """
    w = Window.partitionBy(*group_cols).orderBy(F.desc(score), F.asc(term))
    # filter on the raw row_number so Catalyst infers the group limit
    return (weights.withColumn("_rn", F.row_number().over(w))
                   .filter(F.col("_rn") <= k)
                   .withColumn("rank", (F.col("_rn") - 1).cast("long")).drop("_rn"))


def first_token(corpus_long: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The corpus token at the lowest ``(doc_id, pos)`` as a one-row frame."""
    return corpus_long.agg(F.min_by("term", F.struct(id_col, "pos")).alias("_first"))


def repair_oov(topics: DataFrame, corpus_long: DataFrame, term: str = "term",
               id_col: str = "doc_id") -> DataFrame:
    """A topic word absent from the corpus becomes the corpus's first token."""
    known = corpus_long.select(F.col("term").alias("_known")).distinct()
    first = first_token(corpus_long, id_col)
    out = (topics.join(known, topics[term] == known["_known"], "left")
                 .crossJoin(F.broadcast(first))        # one-row side
                 .withColumn("oov", F.col("_known").isNull())
                 .withColumn(term, F.when(F.col("_known").isNull(), F.col("_first")).otherwise(F.col(term))))
    return out.drop("_known", "_first")


def parse_topic_string(col) -> "F.Column":
    """``0.05*"word" + ...`` -> words (letter runs)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(c, F.lit("[a-zA-Z]+"), F.lit(0))
