"""Queries: time bins on ``events`` and topics over time on ``documents``.

``documents`` has no timestamp; ``doc_id`` serves as the sortable time
value (same expression in the oracle), cut into 4 equal-width slices.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coherence as Q
from ..operators import timebins as TB
from ..session import pinned, spread
from ..sources.tables import read_table
from . import corpus as C
from . import oracle as O
from .q_coherence import direct_sql, win_ctes
from .registry import r6, register

N_BINS_EVENTS, N_SLICES, SLICE_K = 10, 4, 5


def _events_us(spark, d):
    e = read_table(spark, d, "events")
    return e.select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"))


BIN_SQL = """CAST(least({n}, greatest(1, ceil(coalesce(({x} - mn) / nullif((mx - mn) / {n}, 0), 0.0)))) AS BIGINT)"""


def bin_sql(x: str, n: int) -> str:
    return BIN_SQL.format(x=x, n=n)


EV_SQL = f"""ev AS (SELECT event_id, event_type, epoch_us(ts)::DOUBLE AS t FROM events),
rng AS (SELECT min(t) AS mn, max(t) AS mx FROM ev),
evb AS (SELECT event_id, event_type, {bin_sql('t', N_BINS_EVENTS)} AS bin, mn, mx FROM ev, rng)"""


@register("o1_time_bins_events", f"""
WITH {EV_SQL}
SELECT event_id, bin, round(CASE WHEN bin = 1 THEN mn - (mx - mn) * 0.001 ELSE mn + (bin - 1) * ((mx - mn) / {N_BINS_EVENTS}) END, 0) AS bin_start
FROM evb
""")
def o1_time_bins_events(spark, d):
    b = TB.equal_width_bins(_events_us(spark, d), "t_us", N_BINS_EVENTS)
    return b.select("event_id", "bin", F.round("bin_start", 0).alias("bin_start"))


@register("o2_counts_per_bin", f"""
WITH {EV_SQL},
allb AS (SELECT unnest(range(1, {N_BINS_EVENTS} + 1)) AS bin)
SELECT CAST(bin AS BIGINT) AS bin, count(event_id) AS n FROM allb LEFT JOIN evb USING (bin) GROUP BY bin
""")
def o2_counts_per_bin(spark, d):
    b = TB.equal_width_bins(_events_us(spark, d), "t_us", N_BINS_EVENTS)
    return TB.counts_per_bin(b, N_BINS_EVENTS)


@register("o2_counts_per_bin_type", f"""
WITH {EV_SQL}
SELECT event_type, bin, count(*) AS n FROM evb GROUP BY ALL
""")
def o2_counts_per_bin_type(spark, d):
    b = TB.equal_width_bins(_events_us(spark, d), "t_us", N_BINS_EVENTS)
    return b.groupBy("event_type", "bin").agg(F.count(F.lit(1)).alias("n"))


def _sliced_long(spark, d):
    long = C.restricted_long(spark, d)
    return TB.equal_width_bins(long.withColumn("t", F.col("doc_id").cast("double")), "t", N_SLICES, "time_slice")


SLICE_SQL = f"""{O.restricted_ctes()},
rng AS (SELECT min(doc_id)::DOUBLE AS mn, max(doc_id)::DOUBLE AS mx FROM rlong),
sl AS (SELECT rlong.*, {bin_sql('doc_id::DOUBLE', N_SLICES)} AS time_slice FROM rlong, rng),
cnt AS (SELECT time_slice, source AS topic, term, count(*) AS n FROM sl GROUP BY ALL),
tot AS (SELECT time_slice, topic, sum(n) AS tot FROM cnt GROUP BY ALL),
f AS (SELECT term, sum(n) AS f FROM cnt GROUP BY term),
pc AS (SELECT topic, sum(n) AS ct FROM cnt GROUP BY topic),
a AS (SELECT floor(avg(ct)) AS a FROM pc),
w AS (SELECT time_slice, topic, term, (n / tot) * ln(1.0 + a / f) AS weight FROM cnt JOIN tot USING (time_slice, topic) JOIN f USING (term) CROSS JOIN a),
top AS (SELECT time_slice, topic, term, weight, row_number() OVER (PARTITION BY time_slice, topic ORDER BY weight DESC, term) - 1 AS rank
        FROM w QUALIFY rank < {SLICE_K}),
freq AS (SELECT time_slice, source AS topic, count(DISTINCT doc_id) AS frequency FROM sl GROUP BY ALL),
tot_t AS (SELECT top.*, frequency FROM top JOIN freq USING (time_slice, topic))"""


def _tot(spark, d):
    return TB.topics_over_time(_sliced_long(spark, d), "time_slice", "source", SLICE_K)


@register("o3_topics_over_time", f"""
WITH {SLICE_SQL}
SELECT time_slice, topic, frequency, rank, term, round(weight, 6) AS weight FROM tot_t
""")
def o3_topics_over_time(spark, d):
    t = _tot(spark, d)
    return t.select("time_slice", "topic", "frequency", "rank", "term", r6("weight").alias("weight"))


@register("o4_slice_extraction", f"""
WITH {SLICE_SQL},
pos AS (SELECT time_slice, topic, row_number() OVER (PARTITION BY time_slice ORDER BY frequency, topic) - 1 AS position
        FROM (SELECT DISTINCT time_slice, topic, frequency FROM tot_t))
SELECT time_slice, position, topic, rank, term FROM tot_t JOIN pos USING (time_slice, topic)
""")
def o4_slice_extraction(spark, d):
    s = TB.slice_topics(_tot(spark, d))
    return s.select("time_slice", "position", "topic", "rank", "term")


@register("o5_slice_repair", f"""
WITH {SLICE_SQL},
known AS (SELECT DISTINCT term FROM rlong),
first AS (SELECT term AS first FROM rlong ORDER BY doc_id, pos LIMIT 1)
SELECT time_slice, topic, rank, coalesce(k.term, (SELECT first FROM first)) AS term, k.term IS NULL AS oov
FROM tot_t t LEFT JOIN known k ON k.term = t.term
""")
def o5_slice_repair(spark, d):
    r = TB.repair_slices(_tot(spark, d), C.restricted_long(spark, d).select("doc_id", "pos", "term"))
    return r.select("time_slice", "topic", "rank", "term", "oov")


def _o6_sql() -> str:
    parts = []
    ctes = []
    for sl in range(1, N_SLICES + 1):
        ctes.append(f"t{sl} AS (SELECT topic, rank, term FROM tot_t WHERE time_slice = {sl})")
        ctes.append(win_ctes(f"s{sl}", "corp", f"t{sl}", "sliding", 10))
        parts.append(f"""SELECT CAST({sl} AS BIGINT) AS time_slice,
  (SELECT round(avg(npmi), 6) FROM ({direct_sql(f's{sl}', True, 'npmi')})) AS npmi,
  (SELECT round(count(DISTINCT term) / ({SLICE_K}.0 * count(DISTINCT topic)), 6) FROM t{sl}) AS diversity
  WHERE EXISTS (SELECT 1 FROM t{sl})""")
    return f"WITH {SLICE_SQL},\ncorp AS (SELECT doc_id, term, pos, n FROM rlong),\n" + ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(parts)


@register("o6_per_slice_scores", _o6_sql())
def o6_per_slice_scores(spark, d):
    corpus = C.restricted_corpus(spark, d).select("doc_id", "tokens")
    topics = pinned(_tot(spark, d).select("time_slice", "topic", "rank", "term"))
    keys = ["time_slice"]
    n = Q.mean_over_topics(Q.npmi(corpus, topics, keys), keys, "npmi")
    dv = Q.diversity(topics, keys, SLICE_K)
    return n.join(dv, keys).select("time_slice", r6("npmi").alias("npmi"), r6("diversity").alias("diversity"))
