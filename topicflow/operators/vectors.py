"""Vector operators on ``ARRAY<FLOAT|DOUBLE>`` columns.

Topic vectors are bounded by the topic count K, so they travel as one
broadcast row (``ARRAY<STRUCT<topic, vec>>``); per-item scores against all
K topics are array expressions, and per-topic best items use
``row_number() <= k`` (partial WindowGroupLimit before the shuffle).
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_double(col) -> Column:
    return F.transform(_c(col), lambda x: x.cast("double"))


def norm(col) -> Column:
    return F.sqrt(F.aggregate(as_double(col), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalise(col) -> Column:
    """M6: unit length (a zero vector gives nulls)."""
    n = norm(col)
    return F.transform(as_double(col), lambda x: x / F.nullif(n, F.lit(0.0)))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def scale(col, gamma: float) -> Column:
    return F.transform(as_double(col), lambda x: x * gamma)


def hybrid(lda_col, emb_col, gamma: float = 30.0) -> Column:
    """M5: ``[gamma * topic distribution || embedding]``."""
    return F.concat(scale(lda_col, gamma), as_double(emb_col))


def one_hot(index_col, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)),
                       lambda i: F.when(i == _c(index_col), F.lit(1.0)).otherwise(F.lit(0.0)))


def topic_vectors(df: DataFrame, label: str, vec: str, noise_label: int | None = -1) -> DataFrame:
    """Unit-length mean vector per cluster (noise excluded), ``(topic, vec)``.

    ``Summarizer.mean`` merges partial sums map-side, so one huge cluster
    costs no more than its share of the scan.
    """
    src = df if noise_label is None else df.filter(F.col(label) != noise_label)
    m = src.groupBy(F.col(label).alias("topic")).agg(Summarizer.mean(array_to_vector(as_double(vec))).alias("_m"))
    return m.select("topic", l2_normalise(vector_to_array("_m")).alias("vec"))


def _topic_row(topics: DataFrame) -> DataFrame:
    """All topic vectors in one row (bounded by K), for a one-row broadcast."""
    return topics.agg(F.array_sort(F.collect_list(F.struct("topic", "vec"))).alias("_topics"))


def scores_against_topics(items: DataFrame, topics: DataFrame, vec: str) -> DataFrame:
    """Items with ``_scores: ARRAY<STRUCT<topic, score>>`` against every topic."""
    j = items.crossJoin(F.broadcast(_topic_row(topics)))       # one-row side
    return j.withColumn("_scores", F.transform("_topics", lambda t: F.struct(
        t["topic"].alias("topic"), dot(t["vec"], F.col(vec)).alias("score")))).drop("_topics")


def nearest_topic(items: DataFrame, topics: DataFrame, vec: str) -> DataFrame:
    """Argmax inner product per item (ties: lowest topic) and its score."""
    s = scores_against_topics(items, topics, vec)
    best = F.aggregate("_scores", F.struct(F.lit(None).cast("long").alias("topic"), F.lit(None).cast("double").alias("score")),
                       lambda acc, x: F.when(acc["score"].isNull() | (x["score"] > acc["score"]),
                                             F.struct(x["topic"].cast("long").alias("topic"), x["score"].alias("score")))
                       .otherwise(acc))
    return s.withColumn("_b", best).withColumn("topic", F.col("_b.topic")).withColumn("score", F.col("_b.score")).drop("_b", "_scores")


def top_items(items: DataFrame, topics: DataFrame, vec: str, id_col: str, k: int = 10) -> DataFrame:
    """Best ``k`` items per topic by inner product, ``(topic, rank, id, score)``."""
    s = scores_against_topics(items.select(id_col, vec), topics, vec)
    e = s.select(id_col, F.explode("_scores").alias("_s")).select(id_col, F.col("_s.topic").alias("topic"),
                                                                   F.col("_s.score").alias("score"))
    w = Window.partitionBy("topic").orderBy(F.desc("score"), F.asc(id_col))
    return (e.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
             .withColumn("rank", (F.col("_rn") - 1).cast("long")).drop("_rn"))


def topic_sizes(assign: DataFrame, topic: str = "topic") -> DataFrame:
    """Documents per topic."""
    return assign.groupBy(topic).agg(F.count(F.lit(1)).alias("n"))


def reorder_by_size(assign: DataFrame, topic: str = "topic") -> DataFrame:
    """``(old_topic, new_topic, n)``: largest first, ties by old id."""
    sizes = topic_sizes(assign, topic)
    w = Window.orderBy(F.desc("n"), F.asc(topic))          # one row per topic
    return sizes.select(F.col(topic).alias("old_topic"), (F.row_number().over(w) - 1).cast("long").alias("new_topic"), "n")


def topic_pairs(topics: DataFrame, min_cos: float) -> DataFrame:
    """M13 (pairs): topic pairs whose cosine similarity is at least ``min_cos``.

    K x K over the bounded topic table.
    """
    a = topics.select(F.col("topic").alias("a"), F.col("vec").alias("va"))
    b = topics.select(F.col("topic").alias("b"), F.col("vec").alias("vb"))
    cos = dot("va", "vb") / (norm("va") * norm("vb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", cos.alias("cos")).filter(F.col("cos") >= min_cos)


def components(nodes: DataFrame, edges: DataFrame, node: str = "topic") -> DataFrame:
    """Connected components: ``(node, component)``, the component named by its least node."""
    from .density import label_components
    und = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(
        edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
    lab = label_components(nodes.select(F.col(node).alias("v")), und, "v", "u")
    return lab.select(F.col("v").alias(node), F.col("c").alias("component"))


def deduplicate_topics(topics: DataFrame, max_cos_dist: float = 0.1) -> DataFrame:
    """Topics within cosine distance ``max_cos_dist`` of another are
    merged per connected component into one unit mean vector; isolated
    topics stay.  ``(topic, vec, members)``; topic = smallest member id."""
    edges = topic_pairs(topics, 1.0 - max_cos_dist)
    comp = components(topics.select("topic"), edges)
    j = topics.join(comp, "topic")
    m = j.groupBy("component").agg(Summarizer.mean(array_to_vector("vec")).alias("_m"),
                                   F.array_sort(F.collect_list("topic")).alias("members"))
    return m.select(F.col("component").alias("topic"), l2_normalise(vector_to_array("_m")).alias("vec"), "members")
