"""Queries: embedding vectors, cluster topic vectors and assignments.

``embeddings.label`` (10 values) stands in for cluster labels so the
deterministic half is checked by SQL; the fitted half (PCA, k-means) is in
``q_models``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vectors as V
from ..session import spread
from ..sources.tables import read_table
from .registry import r6, register


def emb(spark, d):
    return read_table(spark, d, "embeddings")


def _long(df, id_cols, vec):
    return df.select(*id_cols, F.posexplode(vec).alias("dim", "value")).select(
        *id_cols, F.col("dim").cast("long").alias("dim"), r6("value").alias("value"))


UNIT_SQL = """unit AS (SELECT vec_id, label, e, list_transform(e, lambda x: x / nullif(sqrt(list_sum(list_transform(e, lambda y: y * y))), 0)) AS u
                FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"""
TV_SQL = f"""{UNIT_SQL},
el AS (SELECT vec_id, label, unnest(u) AS x, unnest(range(len(u))) AS dim FROM unit),
mean AS (SELECT label AS topic, dim, avg(x) AS m FROM el GROUP BY ALL),
nrm AS (SELECT topic, sqrt(sum(m * m)) AS nn FROM mean GROUP BY topic),
tv AS (SELECT topic, dim, m / nullif(nn, 0) AS v FROM mean JOIN nrm USING (topic)),
sc AS (SELECT u.vec_id, t.topic, sum(u.x * t.v) AS score FROM el u JOIN tv t ON t.dim = u.dim GROUP BY ALL)"""


@register("m6_l2_normalise", f"""
WITH {UNIT_SQL}
SELECT vec_id, CAST(dim AS BIGINT) AS dim, round(value, 6) AS value FROM (SELECT vec_id, unnest(u) AS value, unnest(range(len(u))) AS dim FROM unit)
""")
def m6_l2_normalise(spark, d):
    e = emb(spark, d).select("vec_id", V.l2_normalise("embedding").alias("u"))
    return _long(e, ["vec_id"], "u")


@register("m5_hybrid_vector", f"""
WITH h AS (SELECT vec_id, list_concat(list_transform(range(10), lambda i: CASE WHEN i = label THEN 30.0 ELSE 0.0 END), CAST(embedding AS DOUBLE[])) AS hv FROM embeddings)
SELECT vec_id, CAST(dim AS BIGINT) AS dim, round(value, 6) AS value FROM (SELECT vec_id, unnest(hv) AS value, unnest(range(len(hv))) AS dim FROM h)
""")
def m5_hybrid_vector(spark, d):
    """M5 with a one-hot label as the topic distribution, gamma 30."""
    e = emb(spark, d).select("vec_id", V.hybrid(V.one_hot("label", 10), "embedding", 30.0).alias("hv"))
    return _long(e, ["vec_id"], "hv")


def _topic_vectors(spark, d):
    e = emb(spark, d).select("vec_id", "label", V.l2_normalise("embedding").alias("u"))
    return e, V.topic_vectors(e, "label", "u")


@register("m12_topic_vectors", f"""
WITH {TV_SQL}
SELECT CAST(topic AS BIGINT) AS topic, CAST(dim AS BIGINT) AS dim, round(v, 6) AS value FROM tv
""")
def m12_topic_vectors(spark, d):
    _, tv = _topic_vectors(spark, d)
    return _long(tv.withColumn("topic", F.col("topic").cast("long")), ["topic"], "vec")


@register("m14_top_items_per_topic", f"""
WITH {TV_SQL}
SELECT CAST(topic AS BIGINT) AS topic, rank, vec_id, round(score, 6) AS score FROM (
  SELECT topic, vec_id, score, row_number() OVER (PARTITION BY topic ORDER BY score DESC, vec_id) - 1 AS rank FROM sc)
WHERE rank < 10
""")
def m14_top_items_per_topic(spark, d):
    e, tv = _topic_vectors(spark, d)
    t = V.top_items(e, tv, "u", "vec_id", 10)
    return t.select(F.col("topic").cast("long").alias("topic"), "rank", "vec_id", r6("score").alias("score"))


@register("m15_nearest_topic", f"""
WITH {TV_SQL}
SELECT vec_id, CAST(topic AS BIGINT) AS topic, round(score, 6) AS score FROM sc
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, topic) = 1
""")
def m15_nearest_topic(spark, d):
    e, tv = _topic_vectors(spark, d)
    n = V.nearest_topic(e.select("vec_id", "u"), tv, "u")
    return n.select("vec_id", "topic", r6("score").alias("score"))


@register("m17_topic_sizes", f"""
WITH {TV_SQL}, nt AS (SELECT vec_id, topic FROM sc QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, topic) = 1)
SELECT CAST(topic AS BIGINT) AS topic, count(*) AS n FROM nt GROUP BY topic
""")
def m17_topic_sizes(spark, d):
    e, tv = _topic_vectors(spark, d)
    return V.topic_sizes(V.nearest_topic(e.select("vec_id", "u"), tv, "u"))


@register("m18_reorder_topics", f"""
WITH {TV_SQL}, nt AS (SELECT vec_id, topic FROM sc QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, topic) = 1),
sz AS (SELECT CAST(topic AS BIGINT) AS topic, count(*) AS n FROM nt GROUP BY topic)
SELECT topic AS old_topic, row_number() OVER (ORDER BY n DESC, topic) - 1 AS new_topic, n FROM sz
""")
def m18_reorder_topics(spark, d):
    e, tv = _topic_vectors(spark, d)
    return V.reorder_by_size(V.nearest_topic(e.select("vec_id", "u"), tv, "u"))


@register("m13_topic_pairs", f"""
WITH {TV_SQL},
tn AS (SELECT topic, sqrt(sum(v * v)) AS nn FROM tv GROUP BY topic),
pr AS (SELECT a.topic AS a, b.topic AS b, sum(a.v * b.v) AS dt FROM tv a JOIN tv b ON a.dim = b.dim AND a.topic < b.topic GROUP BY ALL)
SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(dt / (x.nn * y.nn), 6) AS cos
FROM pr JOIN tn x ON x.topic = a JOIN tn y ON y.topic = b WHERE dt / (x.nn * y.nn) >= 0.0
""")
def m13_topic_pairs(spark, d):
    """Topic-vector pairs with non-negative cosine (the de-duplication graph's candidates)."""
    _, tv = _topic_vectors(spark, d)
    p = V.topic_pairs(tv, 0.0)
    return p.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), r6("cos").alias("cos"))


SPLIT_SQL = f"""{UNIT_SQL},
el AS (SELECT label * 3 + vec_id % 3 AS topic, unnest(u) AS x, unnest(range(len(u))) AS dim FROM unit),
mean AS (SELECT topic, dim, avg(x) AS m FROM el GROUP BY ALL),
nrm AS (SELECT topic, sqrt(sum(m * m)) AS nn FROM mean GROUP BY topic),
tv AS (SELECT topic, dim, m / nullif(nn, 0) AS v FROM mean JOIN nrm USING (topic))"""


@register("m13_deduplicate_topics", f"""
WITH RECURSIVE {SPLIT_SQL},
pr AS (SELECT a.topic AS a, b.topic AS b FROM tv a JOIN tv b ON a.dim = b.dim AND a.topic <> b.topic GROUP BY ALL HAVING sum(a.v * b.v) >= 0.25),
reach(topic, r) AS (SELECT DISTINCT topic, topic FROM tv UNION SELECT reach.topic, pr.b FROM reach JOIN pr ON pr.a = reach.r),
comp AS (SELECT topic, min(r) AS c FROM reach GROUP BY topic),
cm AS (SELECT c, dim, avg(v) AS m FROM tv JOIN comp USING (topic) GROUP BY ALL),
cn AS (SELECT c, sqrt(sum(m * m)) AS nn FROM cm GROUP BY c),
sz AS (SELECT c, count(*) AS n FROM comp GROUP BY c)
SELECT CAST(c AS BIGINT) AS topic, n AS n_members, CAST(dim AS BIGINT) AS dim, round(m / nn, 6) AS value FROM cm JOIN cn USING (c) JOIN sz USING (c)
""")
def m13_deduplicate_topics(spark, d):
    """M13 merge step: thirty topics (label by id modulo three), put together by cosine
    distance 0.75 (these vectors lie far apart), components and unit means."""
    e = emb(spark, d).select("vec_id", (F.col("label") * 3 + F.col("vec_id") % 3).alias("topic"), V.l2_normalise("embedding").alias("u"))
    dd = V.deduplicate_topics(V.topic_vectors(e, "topic", "u"), 0.75)
    out = dd.select(F.col("topic").cast("long").alias("topic"), F.size("members").cast("long").alias("n_members"), "vec")
    return _long(out, ["topic", "n_members"], "vec")


# --- grid density (M8 density form) ------------------------------------------------

DENSITY_EPS, DENSITY_DIMS = 0.1, 5


@register("m8_density_cells", f"""
WITH {UNIT_SQL},
c AS (SELECT array_to_string(list_transform(range({DENSITY_DIMS}), lambda j: CAST(floor(list_sum(list_filter(u, lambda x, i: (i - 1) % {DENSITY_DIMS} = j)) / {DENSITY_EPS}) AS BIGINT)), ',') AS cell_key FROM unit)
SELECT cell_key, count(*) AS n FROM c GROUP BY cell_key
""")
def m8_density_cells(spark, d):
    """Points per grid cell of side 0.1 on a 5-dimensional projection of all
    64 unit-vector values (each dimension sums every fifth value)."""
    from ..operators import density
    e = emb(spark, d).select("vec_id", V.l2_normalise("embedding").alias("u"))
    proj = F.transform(F.sequence(F.lit(0), F.lit(DENSITY_DIMS - 1)), lambda j: F.aggregate(
        F.filter("u", lambda x, i: i % DENSITY_DIMS == j), F.lit(0.0), lambda a, x: a + x))
    return density.cell_counts(e.select("vec_id", proj.alias("p")), "p", DENSITY_EPS, DENSITY_DIMS)


@register("m8_density_clusters")
def m8_density_clusters(spark, d):
    """M7 -> grid density clusters on the 5 reduced dimensions (rows check)."""
    from ..operators import density, models as M
    e = emb(spark, d).select("vec_id", V.l2_normalise("embedding").alias("u"))
    red = M.pca(e, "u", 5)
    return density.density_clusters(red, "reduced", eps=0.15, min_pts=3, min_cluster_size=15, id_col="vec_id")
