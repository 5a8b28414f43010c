"""Results analytics (A1-A14): flatten run records, aggregate across runs,
pivot into comparison tables, rank, and build plot series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import pinned


def round3(col) -> F.Column:
    """Round to 3 places half-up on the value's 9-digit decimal form, so
    exact ties (0.5105) break the same way in every engine."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(F.round(c, 9), 3)


def resolve_topic_count(params: str = "Params") -> F.Column:
    """A2: first non-zero of nr_topics, num_topics, n_components."""
    def g(k):
        return F.nullif(F.col(params)[k].cast("long"), F.lit(0))
    return F.coalesce(g("nr_topics"), g("num_topics"), g("n_components"))


def flatten(records: DataFrame, combine_models: bool = False) -> DataFrame:
    """A1 + A3: one row per record with the eight result columns.

    The model label gets ``_<file index>`` (files ordered by name within a
    dataset folder) unless ``combine_models``.  The file index comes from
    the distinct (folder, file) list, not a window over all records.
    """
    scores = F.coalesce(F.col("Scores"), F.col("Score Summary")) if "Score Summary" in records.columns else F.col("Scores")
    df = records.withColumn("_scores", scores)
    if combine_models or "time_slice" in df.columns:       # time-sliced runs keep their model's name
        model = F.col("Model")
    else:
        files = df.select("folder", "file").distinct()
        files = files.withColumn("_fidx", F.dense_rank().over(Window.partitionBy("folder").orderBy("file")) - 1)
        df = df.join(files, ["folder", "file"])
        model = F.concat(F.col("Model"), F.lit("_"), F.col("_fidx").cast("string"))
    extra = ["time_slice"] if "time_slice" in df.columns else []
    return df.select(
        F.col("Dataset"), model.alias("Model"), *extra,
        resolve_topic_count().alias("nr_topics"),
        F.col("_scores")["npmi"].cast("double").alias("npmi"),
        F.col("_scores")["diversity"].cast("double").alias("diversity"),
        F.to_json("Params").alias("params"),
        F.col("Dataset Size").cast("long").alias("Dataset_Size"),
        F.col("Computation Time").cast("double").alias("ComputationTime"))


def mean_per_model(results: DataFrame, cols: Sequence[str] = ("nr_topics", "npmi", "diversity",
                                                             "Dataset_Size", "ComputationTime")) -> DataFrame:
    """A4: numeric means per model."""
    return results.groupBy("Model").agg(*[F.avg(c).alias(c) for c in cols])


def dataset_model_means(results: DataFrame) -> DataFrame:
    """A5: mean npmi and diversity per (dataset, model)."""
    return results.groupBy("Dataset", "Model").agg(F.avg("npmi").alias("npmi"), F.avg("diversity").alias("diversity"))


def model_order(means: DataFrame, dataset: str) -> DataFrame:
    """Models ordered by ascending npmi on ``dataset`` (``order`` 0-based, ties by model)."""
    sel = means.filter(F.col("Dataset") == dataset).select("Model", "npmi")
    sel = pinned(sel)                             # one row per model
    return sel.withColumn("order", (F.row_number().over(Window.orderBy("npmi", "Model")) - 1).cast("long")).select("Model", "order")


def comparison_table(means: DataFrame, datasets: Sequence[str], order_dataset: str) -> DataFrame:
    """One row per model, ``<dataset>_npmi`` / ``<dataset>_diversity``
    columns rounded to 3, aligned on the model order (models missing in the
    order dataset get a null order)."""
    piv = (means.groupBy("Model").pivot("Dataset", list(datasets))
                .agg(round3(F.first("npmi")).alias("npmi"), round3(F.first("diversity")).alias("diversity")))
    order = model_order(means, order_dataset)
    return piv.join(order, "Model", "left")


def topic_quality(table: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """Npmi x diversity per dataset on the rounded table, rounded to 3."""
    return table.select("Model", *[round3(F.col(f"{d}_npmi") * F.col(f"{d}_diversity")).alias(d) for d in datasets])


def top_three(table: DataFrame, value_cols: Sequence[str], key: str = "Model") -> DataFrame:
    """Mark the highest, second and third distinct value per column.

    Unpivots to ``(key, column, value)`` and ranks with ``dense_rank``
    partitioned by column (one partition per column).
    """
    stack = table.select(key, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in value_cols])).alias("_s"))
    long = stack.select(key, "_s.column", "_s.value").filter(F.col("value").isNotNull())
    w = Window.partitionBy("column").orderBy(F.desc("value"))
    ranked = long.withColumn("mark", F.dense_rank().over(w))
    return ranked.withColumn("mark", F.when(F.col("mark") <= 3, F.col("mark").cast("long")))


def metric_series(results: DataFrame, x: str = "nr_topics", y: str = "npmi") -> DataFrame:
    """A10: ``(Model, x, y)`` per run."""
    return results.select("Model", F.col(x).alias("x"), F.col(y).cast("double").alias("y"))


def band_series(results: DataFrame, x: str = "nr_topics", y: str = "npmi") -> DataFrame:
    """Mean and mean +- 0.5 sample std per (model, x)."""
    g = results.groupBy("Model", F.col(x).alias("x")).agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("_sd"))
    return g.select("Model", "x", "mean", (F.col("mean") - 0.5 * F.col("_sd")).alias("lower"),
                    (F.col("mean") + 0.5 * F.col("_sd")).alias("upper"))


def cost_series(computation: DataFrame) -> DataFrame:
    """Time against vocabulary size per model, with the line family."""
    fam = (F.when(F.col("model").contains("bertopic"), "BERTopic")
             .when(F.col("model").contains("top2vec"), "Top2Vec").otherwise("Classic"))
    return computation.select("model", fam.alias("family"), "vocab_size", "time")


def label_models(df: DataFrame, labels: Mapping[str, str], col: str = "model") -> DataFrame:
    """Display label from a (bounded) mapping; unmapped keep their name."""
    m = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))]) if labels else None
    lab = F.coalesce(m[F.col(col)], F.col(col)) if m is not None else F.col(col)
    return df.withColumn("label", lab)


def axis_range(df: DataFrame, col: str, step: float, start: float | None = None, inclusive: bool = True) -> DataFrame:
    """``(lo, hi, ticks)`` with ticks from min (or ``start``) by ``step``, up
    to the maximum or, unless ``inclusive``, to before it; none where the
    maximum lies below the start."""
    lo = F.lit(start) if start is not None else F.min(col)
    a = df.agg(lo.cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))
    last = "cast(hi as bigint)" if inclusive else "cast(ceil(hi) as bigint) - 1"
    ticks = F.expr(f"CASE WHEN cast(lo as bigint) <= {last} THEN sequence(cast(lo as bigint), {last}, cast({step} as bigint)) ELSE array() END")
    return a.withColumn("ticks", ticks)
