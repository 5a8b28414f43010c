"""Queries: window counts and coherence metrics over labelled-class topics.

Oracle side counts windows by exploding every window start of every
topic-word occurrence (brute force), independent of the interval-union
plan used by Spark.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coherence as Q
from . import corpus as C
from . import oracle as O
from .registry import r6, register


def _src_corpus(spark, d):
    return C.restricted_corpus(spark, d).select("doc_id", "tokens")


SRC = f"""{O.restricted_ctes()},
{O.class_topics_ctes('source')},
corp AS (SELECT doc_id, term, pos, n FROM rlong)"""

BENCH = f"""{O.tokenise_cte('bench', 'SELECT item_id AS doc_id, text FROM benchmark')},
{O.long_cte('bench_long', 'bench')}"""

CONV = f"""{O.tokenise_cte('conv', 'SELECT concat(conv_id, chr(58), turn) AS doc_id, role, text FROM conversations', 'role')},
{O.long_cte('conv_long', 'conv', 'role')},
{O.class_topics_ctes('role', 'ctopics', src='conv_long')}"""


def win_ctes(p: str, corpus: str, topics: str, kind: str, size: int) -> str:
    """Brute-force window tables: {p}_W, {p}_single(term, c), {p}_co(a, b, c), {p}_pt(all rank pairs)."""
    if kind == "sliding":
        lo, hi = f"greatest(pos - {size - 1}, 0)", f"least(pos, greatest(n - {size}, 0))"
        per_doc = f"greatest(n - {size} + 1, 1)"
    else:
        lo, hi = f"greatest(pos - {size}, 0)", f"least(pos + {size}, n - 1)"
        per_doc = "n"
    return f"""{p}_occ AS (SELECT doc_id, term, pos, n FROM {corpus} WHERE term IN (SELECT term FROM {topics})),
{p}_W AS (SELECT sum({per_doc})::DOUBLE AS W FROM (SELECT DISTINCT doc_id, n FROM {p}_occ)),
{p}_win AS (SELECT DISTINCT doc_id, term, s FROM (SELECT doc_id, term, unnest(range({lo}, {hi} + 1)) AS s FROM {p}_occ)),
{p}_single AS (SELECT term, count(*) AS c FROM {p}_win GROUP BY term),
{p}_tp AS (SELECT DISTINCT least(x.term, y.term) AS a, greatest(x.term, y.term) AS b
           FROM {topics} x JOIN {topics} y ON x.topic = y.topic AND x.rank < y.rank AND x.term <> y.term),
{p}_co AS (SELECT tp.a, tp.b, count(*) AS c FROM {p}_tp tp
           JOIN {p}_win x ON x.term = tp.a JOIN {p}_win y ON y.term = tp.b AND y.doc_id = x.doc_id AND y.s = x.s
           GROUP BY tp.a, tp.b),
{p}_pt AS (SELECT x.topic, x.rank AS i, y.rank AS j, x.term AS ta, y.term AS tb,
                  coalesce(sa.c, 0)::DOUBLE AS na, coalesce(sb.c, 0)::DOUBLE AS nb,
                  (CASE WHEN x.term = y.term THEN coalesce(sa.c, 0) ELSE coalesce(co.c, 0) END)::DOUBLE AS nab,
                  (SELECT W FROM {p}_W) AS W
           FROM {topics} x JOIN {topics} y ON x.topic = y.topic
           LEFT JOIN {p}_single sa ON sa.term = x.term LEFT JOIN {p}_single sb ON sb.term = y.term
           LEFT JOIN {p}_co co ON co.a = least(x.term, y.term) AND co.b = greatest(x.term, y.term))"""


def lr_sql(normalize: bool) -> str:
    lr = "ln((nab / nullif(W, 0) + 1e-12) / nullif((na / nullif(W, 0)) * (nb / nullif(W, 0)), 0))"
    if normalize:
        lr = f"({lr}) / nullif(-ln(nab / nullif(W, 0) + 1e-12), 0)"
    return f"coalesce({lr}, 0.0)"


def direct_sql(p: str, normalize: bool, name: str) -> str:
    return (f"SELECT topic, avg({lr_sql(normalize)}) AS {name} FROM {p}_pt "
            f"WHERE i < j GROUP BY topic")


def ctxvec_ctes(p: str) -> str:
    return f"""{p}_v AS (SELECT topic, i, tb AS u, sum({lr_sql(True)}) AS v FROM {p}_pt GROUP BY ALL),
{p}_vs AS (SELECT topic, u, sum(v) AS vs FROM {p}_v GROUP BY ALL)"""


def cv_ctes(p: str) -> str:
    return f"""{ctxvec_ctes(p)},
{p}_pw AS (SELECT topic, i, sum(v * vs) AS dot, sum(v * v) AS n1 FROM {p}_v JOIN {p}_vs USING (topic, u) GROUP BY ALL),
{p}_sn AS (SELECT topic, sum(vs * vs) AS n2 FROM {p}_vs GROUP BY topic)"""


def cv_select(p: str) -> str:
    return f"""SELECT topic, avg(coalesce(dot / nullif(sqrt(n1) * sqrt(n2), 0), 0.0)) AS cv
FROM {p}_pw JOIN {p}_sn USING (topic) GROUP BY topic"""


def ca_ctes(p: str) -> str:
    return f"""{ctxvec_ctes(p)},
{p}_nn AS (SELECT topic, i, sum(v * v) AS nn FROM {p}_v GROUP BY ALL),
{p}_dots AS (SELECT x.topic, x.i, y.i AS j, sum(x.v * y.v) AS dot FROM {p}_v x JOIN {p}_v y
             ON x.topic = y.topic AND x.u = y.u AND x.i < y.i GROUP BY ALL)"""


def ca_select(p: str) -> str:
    return f"""SELECT d.topic, avg(coalesce(dot / nullif(sqrt(a.nn) * sqrt(b.nn), 0), 0.0)) AS ca
FROM {p}_dots d JOIN {p}_nn a ON a.topic = d.topic AND a.i = d.i JOIN {p}_nn b ON b.topic = d.topic AND b.i = d.j
GROUP BY d.topic"""


def cp_sql(p: str) -> str:
    pab = "coalesce(nab / nullif(nb, 0), 0.0)"
    panb = "coalesce((na - nab) / nullif(W - nb, 0), 0.0)"
    return (f"SELECT topic, avg(coalesce(({pab} - {panb}) / nullif({pab} + {panb}, 0), 0.0)) AS cp "
            f"FROM {p}_pt WHERE j < i GROUP BY topic")


# --- window counts ---------------------------------------------------------

@register("q_win_single_w10", f"""
WITH {SRC},
{win_ctes('w', 'corp', 'topics', 'sliding', 10)}
SELECT term, c AS n_term, (SELECT W FROM w_W)::BIGINT AS n_windows FROM w_single
""")
def q_win_single_w10(spark, d):
    corpus, topics = _src_corpus(spark, d), C.source_topics(spark, d)
    st = Q.window_stats(corpus, topics, [], "sliding", 10)
    return st.singles.crossJoin(F.broadcast(st.totals)).select("term", "n_term", "n_windows")


@register("q_win_pairs_w110", f"""
WITH {SRC},
{win_ctes('w', 'corp', 'topics', 'sliding', 110)}
SELECT a, b, c AS n_ab FROM w_co
""")
def q_win_pairs_w110(spark, d):
    corpus, topics = _src_corpus(spark, d), C.source_topics(spark, d)
    pc = Q.window_stats(corpus, topics, [], "sliding", 110).pairs
    return pc.filter(F.col("n_ab") > 0).select("a", "b", "n_ab")


# --- coherence per topic ---------------------------------------------------

@register("q_npmi_source", f"""
WITH {SRC},
{win_ctes('w', 'corp', 'topics', 'sliding', 10)}
SELECT topic, round(npmi, 6) AS npmi FROM ({direct_sql('w', True, 'npmi')})
""")
def q_npmi_source(spark, d):
    t = Q.npmi(_src_corpus(spark, d), C.source_topics(spark, d))
    return t.select("topic", r6("npmi").alias("npmi"))


@register("q_uci_source", f"""
WITH {SRC},
{win_ctes('w', 'corp', 'topics', 'sliding', 10)}
SELECT topic, round(uci, 6) AS uci FROM ({direct_sql('w', False, 'uci')})
""")
def q_uci_source(spark, d):
    t = Q.uci(_src_corpus(spark, d), C.source_topics(spark, d))
    return t.select("topic", r6("uci").alias("uci"))


@register("q_cv_source", f"""
WITH {SRC},
{win_ctes('w', 'corp', 'topics', 'sliding', 110)},
{cv_ctes('w')}
SELECT topic, round(cv, 6) AS cv FROM ({cv_select('w')})
""")
def q_cv_source(spark, d):
    t = Q.cv(_src_corpus(spark, d), C.source_topics(spark, d))
    return t.select("topic", r6("cv").alias("cv"))


@register("q_ca_source", f"""
WITH {SRC},
{win_ctes('w', 'corp', 'topics', 'centred', 5)},
{ca_ctes('w')}
SELECT topic, round(ca, 6) AS ca FROM ({ca_select('w')})
""")
def q_ca_source(spark, d):
    t = Q.ca(_src_corpus(spark, d), C.source_topics(spark, d))
    return t.select("topic", r6("ca").alias("ca"))


@register("q_cp_benchmark", f"""
WITH {SRC},
{BENCH},
{win_ctes('w', 'bench_long', 'topics', 'sliding', 70)}
SELECT topic, round(cp, 6) AS cp FROM ({cp_sql('w')})
""")
def q_cp_benchmark(spark, d):
    ref = C.benchmark_corpus(spark, d)
    t = Q.cp(ref, C.source_topics(spark, d))
    return t.select("topic", r6("cp").alias("cp"))


@register("q_cp_source", f"""
WITH {SRC},
{win_ctes('w', 'corp', 'topics', 'sliding', 70)}
SELECT topic, round(cp, 6) AS cp FROM ({cp_sql('w')})
""")
def q_cp_source(spark, d):
    t = Q.cp(_src_corpus(spark, d), C.source_topics(spark, d))
    return t.select("topic", r6("cp").alias("cp"))


@register("q_npmi_conversations", f"""
WITH {CONV},
{win_ctes('w', 'conv_long', 'ctopics', 'sliding', 10)}
SELECT topic, round(npmi, 6) AS npmi FROM ({direct_sql('w', True, 'npmi')})
""")
def q_npmi_conversations(spark, d):
    conv = C.conversation_corpus(spark, d)
    from ..operators import vocab
    topics = C.class_topics(vocab.explode_tokens(conv, keep=("role",)), "role")
    t = Q.npmi(conv.select("doc_id", "tokens"), topics)
    return t.select("topic", r6("npmi").alias("npmi"))


@register("q_all_source", f"""
WITH {SRC},
{BENCH},
{win_ctes('a', 'corp', 'topics', 'sliding', 110)},
{win_ctes('b', 'corp', 'topics', 'sliding', 10)},
{win_ctes('c', 'bench_long', 'topics', 'centred', 5)},
{win_ctes('e', 'bench_long', 'topics', 'sliding', 70)},
{cv_ctes('a')},
{ca_ctes('c')},
cvq AS ({cv_select('a')}),
np AS ({direct_sql('b', True, 'npmi')}),
uc AS ({direct_sql('b', False, 'uci')}),
caq AS ({ca_select('c')}),
cpq AS ({cp_sql('e')}),
cnt AS (SELECT term, count(*) AS k FROM topics GROUP BY term),
un AS (SELECT topic, avg(1.0 / k) AS u FROM topics JOIN cnt USING (term) GROUP BY topic)
SELECT (SELECT round(avg(cv), 6) FROM cvq) AS cv, (SELECT round(avg(npmi), 6) FROM np) AS npmi,
       (SELECT round(avg(uci), 6) FROM uc) AS uci,
       (SELECT round(count(DISTINCT term) / (10.0 * count(DISTINCT topic)), 6) FROM topics) AS diversity,
       (SELECT round(avg(ca), 6) FROM caq) AS C_A, (SELECT round(avg(cp), 6) FROM cpq) AS C_P,
       (SELECT round(avg(u), 6) FROM un) AS uniqueness
""")
def q_all_source(spark, d):
    s = Q.score_summary(_src_corpus(spark, d), C.source_topics(spark, d),
                        reference=C.benchmark_corpus(spark, d))
    return s.select(*[r6(c).alias(c) for c in ("cv", "npmi", "uci", "diversity", "C_A", "C_P", "uniqueness")])
