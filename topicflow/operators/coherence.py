"""Topic scoring (Q-win, Q-npmi, Q-uci, Q-cv, Q-cp, Q-ca, Q-div, Q-uniq, Q-all).

Inputs: topics ``(*keys, topic, rank, term)`` (0-based rank, already cut to
top-k) and a reference corpus ``(doc_id, tokens)``.  ``keys`` (run id, time
slice, ...) score many topic sets in one job over one corpus scan.

Window counting (Roeder, Both & Hinneburg 2015 probability estimates):

* boolean sliding window of size w, step 1; a document of n tokens has
  ``max(1, n-w+1)`` windows; only documents holding at least one topic word
  of the set are counted, as the word-occurrence accumulator does.
* centred context window of radius r: one window per token position.

An occurrence at position p lies in windows whose starts form the interval
``[lo, hi]``; lo and hi never decrease with p, so the windows holding term
a in a document are the union of its sorted intervals, measured with one
``lag``.  Windows holding a and b: ``N(a) + N(b) - N(a or b)``, the union
running over both terms' occurrences.  Cost follows topic-word occurrences
times (k-1) pairs, never corpus x window size, and no pair list is built
from the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pinned, materialise

EPS = 1e-12


def _sliding_interval(w: int) -> tuple[Column, Column]:
    lo = F.greatest(F.col("pos") - (w - 1), F.lit(0))
    hi = F.least(F.col("pos"), F.greatest(F.col("n") - w, F.lit(0)))
    return lo, hi


def _centred_interval(r: int) -> tuple[Column, Column]:
    lo = F.greatest(F.col("pos") - r, F.lit(0))
    hi = F.least(F.col("pos") + r, F.col("n") - 1)
    return lo, hi


def topic_occurrences(corpus: DataFrame, topics: DataFrame, keys: Sequence[str] = (),
                      tokens: str = "tokens") -> DataFrame:
    """``(*keys, doc_id, n, pos, term)`` for every corpus occurrence of a topic word.

    The stored topic-word table (sets x K x k rows) is broadcast by Spark where
    its size allows.  The result is dealt by document once; all window counts
    then work inside that layout.
    """
    terms = pinned(topics.select(*keys, "term").distinct())
    long = (corpus.select("doc_id", F.size(tokens).alias("n"), F.posexplode_outer(tokens).alias("pos", "term"))
                  .filter(F.col("term").isNotNull()))
    return long.join(terms, "term").repartition("doc_id")


def window_totals(occ: DataFrame, keys: Sequence[str], kind: str, size: int) -> DataFrame:
    """``(*keys, n_windows)`` over relevant documents."""
    docs = occ.select(*keys, "doc_id", "n").distinct()
    per_doc = (F.greatest(F.col("n") - size + 1, F.lit(1)) if kind == "sliding" else F.col("n"))
    return docs.groupBy(*keys).agg(F.sum(per_doc).cast("long").alias("n_windows"))


def _with_interval(occ: DataFrame, kind: str, size: int) -> DataFrame:
    lo, hi = _sliding_interval(size) if kind == "sliding" else _centred_interval(size)
    return occ.withColumn("lo", lo).withColumn("hi", hi)


def _union_len(df: DataFrame, part: Sequence[str]) -> Column:
    w = Window.partitionBy(*part).orderBy("pos")
    prev = F.lag("hi").over(w)
    start = F.when(prev.isNull(), F.col("lo")).otherwise(F.greatest(F.col("lo"), prev + 1))
    return F.greatest(F.col("hi") - start + 1, F.lit(0))


def single_counts(occ: DataFrame, keys: Sequence[str], kind: str, size: int) -> DataFrame:
    """Q-win: ``(*keys, term, n_term)`` windows holding the term."""
    iv = _with_interval(occ, kind, size)
    part = [*keys, "term", "doc_id"]
    return (iv.withColumn("_add", _union_len(iv, part))
              .groupBy(*keys, "term").agg(F.sum("_add").cast("long").alias("n_term")))


def rank_pairs(topics: DataFrame, keys: Sequence[str], include_diagonal: bool = False,
               ordered: bool = False) -> DataFrame:
    """``(*keys, topic, i, j, a, b)`` pairs of rank positions within each topic."""
    l = topics.select(*keys, "topic", F.col("rank").alias("i"), F.col("term").alias("a"))
    r = topics.select(*keys, "topic", F.col("rank").alias("j"), F.col("term").alias("b"))
    cond = (F.col("i") != F.col("j")) if ordered else (F.col("i") < F.col("j"))
    if include_diagonal:
        cond = cond | (F.col("i") == F.col("j"))
    return l.join(r, [*keys, "topic"]).filter(cond)


def pair_counts(occ: DataFrame, pairs: DataFrame, keys: Sequence[str], kind: str, size: int,
                singles: DataFrame) -> DataFrame:
    """``(*keys, a, b, n_ab)`` for distinct unordered term pairs (a < b)."""
    tp = (pairs.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
               .filter(F.col("a") < F.col("b")).distinct())
    # One row for each end of a pair (sets x K x k^2, stored, so Spark knows the
    # size); each occurrence meets its (k-1) pairs per topic in one join.
    ends = pinned(tp.select(*keys, "a", "b", F.explode(F.array("a", "b")).alias("term")))
    both = _with_interval(occ.join(ends, [*keys, "term"]).select(*keys, "a", "b", "doc_id", "n", "pos"), kind, size)
    union = (both.withColumn("_add", _union_len(both, [*keys, "a", "b", "doc_id"]))
                 .groupBy(*keys, "a", "b").agg(F.sum("_add").alias("_u")))
    sa = singles.select(*keys, F.col("term").alias("a"), F.col("n_term").alias("_na"))
    sb = singles.select(*keys, F.col("term").alias("b"), F.col("n_term").alias("_nb"))
    return (union.join(sa, [*keys, "a"]).join(sb, [*keys, "b"])
                 .select(*keys, "a", "b", (F.col("_na") + F.col("_nb") - F.col("_u")).cast("long").alias("n_ab")))


@dataclass
class WindowStats:
    totals: DataFrame   # (*keys, n_windows)
    singles: DataFrame  # (*keys, term, n_term)
    pairs: DataFrame    # (*keys, a, b, n_ab), a < b


def window_stats(corpus: DataFrame, topics: DataFrame, keys: Sequence[str], kind: str, size: int,
                 tokens: str = "tokens", occ: DataFrame | None = None) -> WindowStats:
    """Totals, single and pair window counts for one window definition.

    The corpus-proportional work (occurrences, interval unions) runs
    distributed over a persisted occurrence table dealt by document; the three
    results are bounded by the topic sets (terms, term pairs) and are stored.
    """
    own = occ is None
    if own:
        occ = materialise(topic_occurrences(corpus, topics, keys, tokens))
    totals = pinned(window_totals(occ, keys, kind, size))
    singles = pinned(single_counts(occ, keys, kind, size))
    pairs = rank_pairs(topics, keys)
    pc = pinned(pair_counts(occ, pairs, keys, kind, size, singles))
    if own:
        occ.unpersist()
    return WindowStats(totals, singles, pc)


def _pair_table(topics: DataFrame, keys: Sequence[str], totals: DataFrame, singles: DataFrame,
                pc: DataFrame, include_diagonal: bool, ordered: bool) -> DataFrame:
    """Rank pairs with p_a, p_b, p_ab attached (unseen terms count 0)."""
    pairs = rank_pairs(topics, keys, include_diagonal, ordered)
    sa = singles.select(*keys, F.col("term").alias("a"), F.col("n_term").alias("na"))
    sb = singles.select(*keys, F.col("term").alias("b"), F.col("n_term").alias("nb"))
    pcx = pc.select(*keys, F.col("a").alias("_x"), F.col("b").alias("_y"), "n_ab")
    t = (pairs.join(F.broadcast(totals), list(keys), "left") if keys else pairs.crossJoin(F.broadcast(totals)))
    t = (t.join(sa, [*keys, "a"], "left").join(sb, [*keys, "b"], "left")
          .withColumn("_x", F.least("a", "b")).withColumn("_y", F.greatest("a", "b"))
          .join(pcx, [*keys, "_x", "_y"], "left")
          .withColumn("na", F.coalesce("na", F.lit(0)))
          .withColumn("nb", F.coalesce("nb", F.lit(0)))
          .withColumn("n_ab", F.when(F.col("a") == F.col("b"), F.col("na"))
                               .otherwise(F.coalesce("n_ab", F.lit(0))))
          .withColumn("W", F.coalesce(F.col("n_windows").cast("double"), F.lit(0.0))))
    return t.drop("_x", "_y", "n_windows")


def _log_ratio(normalize: bool) -> Column:
    p_a = F.try_divide(F.col("na"), F.col("W"))
    p_b = F.try_divide(F.col("nb"), F.col("W"))
    p_ab = F.try_divide(F.col("n_ab"), F.col("W"))
    lr = F.log(F.try_divide(p_ab + EPS, p_a * p_b))
    if normalize:
        lr = F.try_divide(lr, -F.log(p_ab + EPS))
    return F.coalesce(lr, F.lit(0.0))


def _stats(stats, corpus, topics, keys, kind, size, tokens):
    return stats if stats is not None else window_stats(corpus, topics, keys, kind, size, tokens)


def _direct(corpus, topics, keys, size, normalize, name, tokens, stats=None):
    st = _stats(stats, corpus, topics, keys, "sliding", size, tokens)
    t = _pair_table(topics, keys, st.totals, st.singles, st.pairs, False, False)
    return (t.withColumn("_m", _log_ratio(normalize))
             .groupBy(*keys, "topic").agg(F.avg("_m").alias(name)))


def npmi(corpus: DataFrame, topics: DataFrame, keys: Sequence[str] = (), window: int = 10,
         tokens: str = "tokens", stats: WindowStats | None = None) -> DataFrame:
    """Q-npmi per topic: mean NPMI over word pairs, sliding window 10."""
    return _direct(corpus, topics, keys, window, True, "npmi", tokens, stats)


def uci(corpus: DataFrame, topics: DataFrame, keys: Sequence[str] = (), window: int = 10,
        tokens: str = "tokens", stats: WindowStats | None = None) -> DataFrame:
    """Q-uci per topic: mean PMI over word pairs, sliding window 10."""
    return _direct(corpus, topics, keys, window, False, "uci", tokens, stats)


def _context_vectors(t: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Word context vectors v_i[u] = sum_{j: t_j=u} npmi(t_i, u) and the set
    vector V[u] = sum_i v_i[u], from a pair table that includes i == j."""
    t = t.withColumn("_m", _log_ratio(True))
    v = t.groupBy(*keys, "topic", "i", F.col("b").alias("u")).agg(F.sum("_m").alias("v"))
    V = v.groupBy(*keys, "topic", "u").agg(F.sum("v").alias("vs"))
    return v, V


def _cos(dot: str, n1: str, n2: str) -> Column:
    return F.coalesce(F.try_divide(F.col(dot), F.sqrt(F.col(n1)) * F.sqrt(F.col(n2))), F.lit(0.0))


def cv(corpus: DataFrame, topics: DataFrame, keys: Sequence[str] = (), window: int = 110,
       tokens: str = "tokens", stats: WindowStats | None = None) -> DataFrame:
    """Q-cv per topic: each word against the whole set; cosine of NPMI
    context vectors; sliding window 110."""
    st = _stats(stats, corpus, topics, keys, "sliding", window, tokens)
    t = _pair_table(topics, keys, st.totals, st.singles, st.pairs, True, True)
    v, V = _context_vectors(t, keys)
    g = [*keys, "topic"]
    vv = v.join(V, [*g, "u"])
    per_word = vv.groupBy(*g, "i").agg(F.sum(F.col("v") * F.col("vs")).alias("_dot"),
                                       F.sum(F.col("v") * F.col("v")).alias("_n1"))
    setn = V.groupBy(*g).agg(F.sum(F.col("vs") * F.col("vs")).alias("_n2"))
    return (per_word.join(setn, g).withColumn("_c", _cos("_dot", "_n1", "_n2"))
                    .groupBy(*g).agg(F.avg("_c").alias("cv")))


def ca(corpus: DataFrame, topics: DataFrame, keys: Sequence[str] = (), radius: int = 5,
       tokens: str = "tokens", stats: WindowStats | None = None) -> DataFrame:
    """Q-ca per topic: pairs of words, cosine of their NPMI context vectors,
    counts from centred context windows of +-radius."""
    st = _stats(stats, corpus, topics, keys, "centred", radius, tokens)
    t = _pair_table(topics, keys, st.totals, st.singles, st.pairs, True, True)
    v, _ = _context_vectors(t, keys)
    g = [*keys, "topic"]
    v1 = v.select(*g, "i", "u", F.col("v").alias("v1"))
    v2 = v.select(*g, F.col("i").alias("j"), "u", F.col("v").alias("v2"))
    dots = (v1.join(v2, [*g, "u"]).filter(F.col("i") < F.col("j"))
              .groupBy(*g, "i", "j").agg(F.sum(F.col("v1") * F.col("v2")).alias("_dot")))
    norms = v.groupBy(*g, "i").agg(F.sum(F.col("v") * F.col("v")).alias("_nn"))
    n1 = norms.select(*g, "i", F.col("_nn").alias("_n1"))
    n2 = norms.select(*g, F.col("i").alias("j"), F.col("_nn").alias("_n2"))
    return (dots.join(n1, [*g, "i"]).join(n2, [*g, "j"])
                .withColumn("_c", _cos("_dot", "_n1", "_n2"))
                .groupBy(*g).agg(F.avg("_c").alias("ca")))


def cp(corpus: DataFrame, topics: DataFrame, keys: Sequence[str] = (), window: int = 70,
       tokens: str = "tokens", stats: WindowStats | None = None) -> DataFrame:
    """Q-cp per topic: each word against each preceding word, Fitelson's
    confirmation ``(P(a|b) - P(a|not b)) / (P(a|b) + P(a|not b))``,
    sliding window 70."""
    st = _stats(stats, corpus, topics, keys, "sliding", window, tokens)
    t = _pair_table(topics, keys, st.totals, st.singles, st.pairs, False, True).filter(F.col("j") < F.col("i"))
    p_ab = F.try_divide(F.col("n_ab"), F.col("nb"))
    p_anb = F.try_divide(F.col("na") - F.col("n_ab"), F.col("W") - F.col("nb"))
    f = F.coalesce(F.try_divide(F.coalesce(p_ab, F.lit(0.0)) - F.coalesce(p_anb, F.lit(0.0)),
                                F.coalesce(p_ab, F.lit(0.0)) + F.coalesce(p_anb, F.lit(0.0))), F.lit(0.0))
    return t.withColumn("_f", f).groupBy(*keys, "topic").agg(F.avg("_f").alias("cp"))


def diversity(topics: DataFrame, keys: Sequence[str] = (), topk: int = 10) -> DataFrame:
    """Q-div: distinct words among the first ``topk`` / (topk x topics)."""
    cut = topics.filter(F.col("rank") < topk)
    return cut.groupBy(*keys).agg(
        (F.count_distinct("term") / (F.lit(topk) * F.count_distinct("topic"))).alias("diversity"))


def uniqueness(topics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Q-uniq: per topic mean of 1/(occurrences of the word over all topics); mean over topics."""
    cnt = topics.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("_cnt"))
    per_topic = (topics.join(cnt, [*keys, "term"])
                       .groupBy(*keys, "topic").agg(F.avg(1.0 / F.col("_cnt")).alias("_u")))
    return per_topic.groupBy(*keys).agg(F.avg("_u").alias("uniqueness"))


def mean_over_topics(per_topic: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    return per_topic.groupBy(*keys).agg(F.avg(metric).alias(metric))


def score_summary(corpus: DataFrame, topics: DataFrame, keys: Sequence[str] = (),
                  reference: DataFrame | None = None, topk: int = 10,
                  tokens: str = "tokens") -> DataFrame:
    """Q-all: one row per topic set with cv, npmi, uci, diversity, C_A, C_P and uniqueness.

    C_A and C_P take ``reference`` (any corpus) when given.
    """
    topics = pinned(topics.filter(F.col("rank") < topk))
    ref = reference if reference is not None else corpus
    # one occurrence table per corpus serves every window definition
    occ = materialise(topic_occurrences(corpus, topics, keys, tokens))
    occ_ref = occ if reference is None else materialise(topic_occurrences(ref, topics, keys, tokens))
    w10 = window_stats(corpus, topics, keys, "sliding", 10, tokens, occ)
    w110 = window_stats(corpus, topics, keys, "sliding", 110, tokens, occ)
    c5 = window_stats(ref, topics, keys, "centred", 5, tokens, occ_ref)
    w70 = window_stats(ref, topics, keys, "sliding", 70, tokens, occ_ref)
    parts = [
        mean_over_topics(cv(corpus, topics, keys, tokens=tokens, stats=w110), keys, "cv"),
        mean_over_topics(npmi(corpus, topics, keys, tokens=tokens, stats=w10), keys, "npmi"),
        mean_over_topics(uci(corpus, topics, keys, tokens=tokens, stats=w10), keys, "uci"),
        diversity(topics, keys, topk),
        mean_over_topics(ca(ref, topics, keys, tokens=tokens, stats=c5), keys, "ca").withColumnRenamed("ca", "C_A"),
        mean_over_topics(cp(ref, topics, keys, tokens=tokens, stats=w70), keys, "cp").withColumnRenamed("cp", "C_P"),
        uniqueness(topics, keys),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(keys), "full") if keys else out.crossJoin(p)
    out = pinned(out)
    occ.unpersist()
    occ_ref.unpersist()
    return out
