"""Queries: results analytics over a run log derived from ``events``.

Each event becomes one run record (the given tables hold no run files):
dataset = event_type, model from ``props.k``, topic count from ``value``,
npmi and diversity from ``value`` and ``k``, file = the event's day.  The
parameter map uses nr_topics / num_topics (with nr_topics 0) /
n_components / nothing by event type, so A2 sees every branch.  The file
readers (S11-S17) are exercised by the tests on generated files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters
from ..operators import results as R
from ..session import spread
from ..sources.tables import read_table
from .registry import r6, register

DATASETS = ("click", "error", "purchase", "signup", "view")
ORDER_DATASET = DATASETS[-2]       # second-to-last dataset orders the models


def run_log(spark, d):
    e = read_table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    nr = ((F.floor(F.col("value") / 100) + 1) * 10).cast("long").cast("string")
    et = F.col("event_type")
    params = (F.when(et.isin("view", "click"), F.create_map(F.lit("nr_topics"), nr))
               .when(et == "purchase", F.create_map(F.lit("nr_topics"), F.lit("0"), F.lit("num_topics"), nr))
               .when(et == "signup", F.create_map(F.lit("n_components"), nr))
               .otherwise(F.create_map().cast("map<string,string>")))
    scores = F.create_map(F.lit("npmi"), (F.col("value") - 250) / 500, F.lit("diversity"), (k + 1) / 100.0)
    return e.select(
        "event_id", et.alias("Dataset"), F.concat(F.lit("model_"), F.floor(k / 20).cast("long").cast("string")).alias("Model"),
        params.alias("Params"), scores.alias("Scores"),
        F.col("user_id").alias("Dataset Size"), F.col("value").alias("Computation Time"),
        et.alias("folder"), F.concat(F.lit("run_"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".json")).alias("file"))


def R3(e: str) -> str:
    return f"CAST(round(CAST(round({e}, 9) AS DECIMAL(38, 9)), 3) AS DOUBLE)"


RUNLOG_SQL = """rl AS (SELECT event_id, event_type AS Dataset,
    'model_' || CAST(CAST(floor(CAST(json_extract_string(props, '$.k') AS BIGINT) / 20) AS BIGINT) AS VARCHAR) AS Model0,
    CAST((floor(value / 100) + 1) * 10 AS BIGINT) AS nr, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    (value - 250) / 500 AS npmi, (CAST(json_extract_string(props, '$.k') AS BIGINT) + 1) / 100.0 AS diversity,
    user_id AS Dataset_Size, value AS ComputationTime,
    'run_' || strftime(ts, '%Y-%m-%d') || '.json' AS file FROM events),
rlf AS (SELECT rl.*, dense_rank() OVER (PARTITION BY Dataset ORDER BY file) - 1 AS fidx,
    CASE WHEN Dataset IN ('view', 'click', 'purchase', 'signup') THEN nr END AS nr_topics FROM rl),
flat AS (SELECT event_id, Dataset, Model0 || '_' || CAST(fidx AS VARCHAR) AS Model, nr_topics, npmi, diversity,
    Dataset_Size, ComputationTime, Model0 FROM rlf)"""


@register("a1_flatten_runs", f"""
WITH {RUNLOG_SQL}
SELECT Dataset, Model, nr_topics, round(npmi, 6) AS npmi, round(diversity, 6) AS diversity, Dataset_Size,
       round(ComputationTime, 6) AS ComputationTime FROM flat
""")
def a1_flatten_runs(spark, d):
    f = R.flatten(run_log(spark, d))
    return f.select("Dataset", "Model", "nr_topics", r6("npmi").alias("npmi"), r6("diversity").alias("diversity"),
                    "Dataset_Size", r6("ComputationTime").alias("ComputationTime"))


@register("a2_topic_count", f"""
WITH {RUNLOG_SQL} SELECT event_id, nr_topics FROM rlf
""")
def a2_topic_count(spark, d):
    return run_log(spark, d).select("event_id", R.resolve_topic_count().alias("nr_topics"))


@register("a4_mean_per_model", f"""
WITH {RUNLOG_SQL}
SELECT Model0 AS Model, round(avg(nr_topics), 6) AS nr_topics, round(avg(npmi), 6) AS npmi,
       round(avg(diversity), 6) AS diversity, round(avg(Dataset_Size), 6) AS Dataset_Size,
       round(avg(ComputationTime), 6) AS ComputationTime FROM flat GROUP BY Model0
""")
def a4_mean_per_model(spark, d):
    m = R.mean_per_model(R.flatten(run_log(spark, d), combine_models=True))
    return m.select("Model", *[r6(c).alias(c) for c in ("nr_topics", "npmi", "diversity", "Dataset_Size", "ComputationTime")])


MEANS_SQL = f"""{RUNLOG_SQL},
means AS (SELECT Dataset, Model0 AS Model, avg(npmi) AS npmi, avg(diversity) AS diversity FROM flat GROUP BY ALL),
ord AS (SELECT Model, row_number() OVER (ORDER BY npmi, Model) - 1 AS "order" FROM means WHERE Dataset = '{ORDER_DATASET}'),
piv AS (SELECT Model, {", ".join(f"{R3(f'max(CASE WHEN Dataset = {chr(39)}{x}{chr(39)} THEN npmi END)')} AS {x}_npmi, {R3(f'max(CASE WHEN Dataset = {chr(39)}{x}{chr(39)} THEN diversity END)')} AS {x}_diversity" for x in DATASETS)}
        FROM means GROUP BY Model),
cmp AS (SELECT piv.*, ord."order" FROM piv LEFT JOIN ord USING (Model))"""


def _means(spark, d):
    return R.dataset_model_means(R.flatten(run_log(spark, d), combine_models=True))


@register("a5_dataset_model_means", f"""
WITH {MEANS_SQL} SELECT Dataset, Model, round(npmi, 6) AS npmi, round(diversity, 6) AS diversity FROM means
""")
def a5_dataset_model_means(spark, d):
    return _means(spark, d).select("Dataset", "Model", r6("npmi").alias("npmi"), r6("diversity").alias("diversity"))


@register("a6_model_order", f"""WITH {MEANS_SQL} SELECT Model, "order" FROM ord""")
def a6_model_order(spark, d):
    return R.model_order(_means(spark, d), ORDER_DATASET)


@register("a7_comparison_table", f"""WITH {MEANS_SQL} SELECT * FROM cmp""")
def a7_comparison_table(spark, d):
    return R.comparison_table(_means(spark, d), DATASETS, ORDER_DATASET)


@register("a8_topic_quality", f"""
WITH {MEANS_SQL}
SELECT Model, {", ".join(f"{R3(f'{x}_npmi * {x}_diversity')} AS {x}" for x in DATASETS)} FROM cmp
""")
def a8_topic_quality(spark, d):
    return R.topic_quality(R.comparison_table(_means(spark, d), DATASETS, ORDER_DATASET), DATASETS)


VALUE_COLS = [f"{x}_{m}" for x in DATASETS for m in ("npmi", "diversity")]


@register("a9_top_three", f"""
WITH {MEANS_SQL},
long AS (UNPIVOT cmp ON {", ".join(VALUE_COLS)} INTO NAME "column" VALUE value)
SELECT Model, "column", CAST(value AS DOUBLE) AS value,
       CASE WHEN dense_rank() OVER (PARTITION BY "column" ORDER BY value DESC) <= 3
            THEN dense_rank() OVER (PARTITION BY "column" ORDER BY value DESC) END AS mark
FROM long WHERE value IS NOT NULL
""")
def a9_top_three(spark, d):
    return R.top_three(R.comparison_table(_means(spark, d), DATASETS, ORDER_DATASET), VALUE_COLS)


@register("a10_metric_series", f"""
WITH {RUNLOG_SQL} SELECT Model0 AS Model, nr_topics AS x, round(npmi, 6) AS y FROM flat
""")
def a10_metric_series(spark, d):
    s = R.metric_series(R.flatten(run_log(spark, d), combine_models=True))
    return s.select("Model", "x", r6("y").alias("y"))


@register("a11_band_series", f"""
WITH {RUNLOG_SQL}
SELECT Model0 AS Model, nr_topics AS x, round(avg(npmi), 6) AS mean,
       round(avg(npmi) - 0.5 * stddev_samp(npmi), 6) AS lower, round(avg(npmi) + 0.5 * stddev_samp(npmi), 6) AS upper
FROM flat GROUP BY Model0, nr_topics
""")
def a11_band_series(spark, d):
    b = R.band_series(R.flatten(run_log(spark, d), combine_models=True))
    return b.select("Model", "x", *[r6(c).alias(c) for c in ("mean", "lower", "upper")])


def computation_log(spark, d):
    e = read_table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.concat("event_type", F.lit(".csv")).alias("model"), (k * 250).cast("double").alias("vocab_size"),
                    F.col("value").alias("time"))


COMP_SQL = """comp AS (SELECT event_type || '.csv' AS model, CAST(json_extract_string(props, '$.k') AS BIGINT) * 250.0::DOUBLE AS vocab_size,
                 value AS time FROM events)"""
LABELS = {"click.csv": "Click", "view.csv": "View", "purchase.csv": "Purchase"}


@register("a12_cost_series", f"""
WITH {COMP_SQL}
SELECT model, 'Classic' AS family, vocab_size, round(time, 6) AS time,
       CASE model {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items())} ELSE model END AS label
FROM comp WHERE model <> 'error.csv'
""")
def a12_cost_series(spark, d):
    """A12 + A13 + P10: cost series without one series, with display labels."""
    c = filters.exclude(computation_log(spark, d), "model", "error.csv")
    s = R.label_models(R.cost_series(c), LABELS)
    return s.select("model", "family", "vocab_size", r6("time").alias("time"), "label")


@register("a14_axis_range", f"""
WITH {RUNLOG_SQL}, {COMP_SQL}
SELECT 'nr_topics' AS axis, min(nr_topics)::DOUBLE AS lo, max(nr_topics)::DOUBLE AS hi,
       array_to_string(range(CAST(min(nr_topics) AS BIGINT), CAST(max(nr_topics) AS BIGINT) + 1, 10), ',') AS ticks FROM flat
UNION ALL
SELECT 'vocab_size', 2500.0, max(vocab_size), array_to_string(range(2500, CAST(ceil(max(vocab_size)) AS BIGINT), 2500), ',') FROM comp
""")
def a14_axis_range(spark, d):
    a = R.axis_range(R.flatten(run_log(spark, d), combine_models=True), "nr_topics", 10).withColumn("axis", F.lit("nr_topics"))
    b = R.axis_range(computation_log(spark, d), "vocab_size", 2500, start=2500, inclusive=False).withColumn("axis", F.lit("vocab_size"))
    return a.unionByName(b).select("axis", "lo", "hi", F.array_join(F.col("ticks").cast("array<string>"), ",").alias("ticks"))


@register("p9_model_subset", f"""
WITH {RUNLOG_SQL} SELECT event_id, Model0 AS Model FROM flat WHERE Model0 IN ('model_0', 'model_2')
""")
def p9_model_subset(spark, d):
    rl = run_log(spark, d)
    return filters.isin_filter(rl, "Model", ["model_0", "model_2"]).select("event_id", "Model")
