"""Quality rules: robust multivariate outliers, in DataFrame functions only.

Each text gets a vector of transformed statistics.  For every language and
source the minimum covariance determinant is sought: starting from medians
and median deviations, concentration steps take the share ``keep`` of the
documents nearest by Mahalanobis distance and estimate mean and covariance
from them, which never raises the determinant.  A document farther than the
chi-square bound ``cutoff`` under the final estimate is rejected.

Statistics are held as whole hundredths, so sums and products are exact and
do not depend on the order of the rows, and the exact percentiles that choose
the nearest documents hold at most one counter for each distinct value.
One row a group is stored and joined back, so Spark
sees its size and a hot group's rows need not meet in one task.  Estimates of
small groups lean on their language's: a group of n documents counts n
against ``lean``.  Symbols, duplicate lines and repeated words are zero in
most texts, so their variance may be zero; ``floors`` is what a deviation is
worth at least, about what the first such line or word adds to a text of
usual length.

Defined results: null and empty texts have no words and fail the base rules;
null languages and sources are groups of their own; repeated rows stay, each
counting once; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored

SPACE, SYMBOLS = r"[\x20\x09-\x0D]", "#*$%&|<>"
X = ("x1", "x2", "x3", "x4", "x5")


@dataclass(frozen=True)
class Params:
    keep: float = 0.75
    steps: int = 4                 # concentration steps
    cutoff: float = 0.999
    lean: int = 50
    floors: tuple = (25, 15, 25, 30, 35)           # hundredths


def chi2_cdf(x: float, k: int) -> float:
    a, t = k / 2, x / 2
    term = total = 1 / math.gamma(a + 1)
    for n in range(1, 500):
        term *= t / (a + n)
        total += term
    return total * t ** a * math.exp(-t)


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return low


def repeated_words(words: Column, size: int = 3) -> Column:
    """Words inside windows of ``size`` words that occur twice or more."""
    def starts(h: Column) -> Column:
        window = F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.struct(
            F.xxhash64(*[F.get(h, i + k) for k in range(size)]).alias("t"), i.alias("i")))

        def same(s: Column) -> Column:
            return F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["t"] == x["t"], F.lit(False))
                            | F.coalesce(F.get(s, k + 1)["t"] == x["t"], F.lit(False)))
        return F.sort_array(F.transform(let(F.sort_array(window), same), lambda x: x["i"]))

    def covered(first: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).alias("last"))
        return F.aggregate(first, zero, lambda a, i: F.struct((a["n"] + F.least(F.lit(size), i - a["last"])).alias("n"), i.alias("last")),
                           lambda a: a["n"])
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.when(F.size(h) >= size, covered(starts(h))).otherwise(F.lit(0).cast("long")))


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the base statistics."""
    text = F.coalesce("text", F.lit(""))
    size = lambda c: F.size(c).cast("long")
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    full = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = let(full, lambda x: size(x) - size(F.array_distinct(x)))
    base = let(words, lambda w: F.struct(size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    chars = lambda drop: F.length(F.translate(text, drop, "")).cast("long")
    rows = docs.select("doc_id", "lang", "source", base.alias("b"), chars(" \t\n\x0b\x0c\r").alias("word_chars"),
                       (F.length(text) - chars(SYMBOLS)).cast("long").alias("n_symbols"), dup.alias("n_dup_lines"))
    rows = rows.select("doc_id", "lang", "source", "b.n_words", "word_chars", "n_symbols", "n_dup_lines", "b.n_repeat_words")
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vector(rows: DataFrame) -> DataFrame:
    """The transformed statistics in hundredths, and the group columns."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda c: F.log(1 + 100 * F.col(c) / n)
    x = (F.log(n.cast("double")), F.col("word_chars") / n, share("n_symbols"), share("n_dup_lines"), share("n_repeat_words"))
    mark = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    return rows.select("*", mark("lang").alias("g1"), mark("source").alias("g2"),
                       *[F.round(100 * c).cast("long").alias(k) for k, c in zip(X, x)])


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    sums = [F.sum(k).alias(f"s_{k}") for k in X]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}{b}") for i, a in enumerate(X) for b in X[:i + 1]]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("m"), *sums, *products)


def _estimate(near: DataFrame, p: Params) -> DataFrame:
    """``g1, g2``, means and the Cholesky factor of the covariance, leaning on the language."""
    group = _moments(near, ["g1", "g2"])
    adds = [c for c in group.columns if c not in ("g1", "g2")]
    lang = group.groupBy("g1").agg(*[F.sum(c).alias("l_" + c) for c in adds])
    t = group.join(lang, "g1")
    w = F.lit(float(p.lean)) / F.col("l_m")
    t = t.select("g1", "g2", *[((F.col(c) + w * F.col("l_" + c)) / (F.col("m") + p.lean)).alias(c) for c in adds if c != "m"])
    t = t.select("g1", "g2", *[F.col(f"s_{k}").alias(f"m_{k}") for k in X], *[
        (F.col(f"p_{a}{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") + (F.lit(float(p.floors[i]) ** 2) if a == b else 0.0)).alias(f"c{i}{j}")
        for i, a in enumerate(X) for j, b in enumerate(X[:i + 1])])
    for i in range(len(X)):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            t = t.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l{j}{j}"))
    return t.drop(*[f"c{i}{j}" for i in range(len(X)) for j in range(i + 1)])


def _distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """``rows`` with the squared Mahalanobis distance ``d2``."""
    out, keep = rows.join(estimate, ["g1", "g2"]), rows.columns
    for i, k in enumerate(X):
        y = F.col(k) - F.col(f"m_{k}")
        for j in range(i):
            y = y - F.col(f"l{i}{j}") * F.col(f"y{j}")
        out = out.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    d2 = F.lit(0.0)
    for i in range(len(X)):
        d2 = d2 + F.col(f"y{i}") ** 2
    return out.select(*keep, d2.alias("d2"))


def _nearest(rows: DataFrame, p: Params) -> DataFrame:
    """The rows of each group up to the ``keep`` percentile of the distance."""
    far = rows.withColumn("q", F.round(100 * F.sqrt("d2")).cast("long"))
    bound = stored(far.groupBy("g1", "g2").agg(F.percentile("q", F.lit(p.keep)).alias("bound")), "quality-bound")
    return far.join(bound, ["g1", "g2"]).where("q <= bound").drop("q", "bound")


def estimate(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """The minimum-covariance-determinant estimate of each group."""
    rows = rows.select("g1", "g2", *X)
    middle = stored(rows.groupBy("g1", "g2").agg(*[F.percentile(k, F.lit(0.5)).alias(f"m_{k}") for k in X]), "quality-middle")
    off = rows.join(middle, ["g1", "g2"]).select("g1", "g2", *X, *[F.abs(F.col(k) - F.col(f"m_{k}")).alias(f"o_{k}") for k in X],
                                                 *[f"m_{k}" for k in X])
    spread = off.groupBy("g1", "g2").agg(*[F.percentile(F.round(f"o_{k}").cast("long"), F.lit(0.5)).alias(f"v_{k}") for k in X])
    spread = stored(spread, "quality-spread")
    first = off.join(spread, ["g1", "g2"])
    d2 = F.lit(0.0)
    for k, floor in zip(X, p.floors):
        d2 = d2 + (F.col(f"o_{k}") / F.greatest(1.4826 * F.col(f"v_{k}"), F.lit(float(floor)))) ** 2
    near = first.select("g1", "g2", *X, d2.alias("d2"))
    for _ in range(p.steps):
        est = stored(_estimate(_nearest(near, p), p), "quality-estimate")
        near = _distance(rows, est)
    return est


def quality(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The contract's rows, with the squared distance as ``d2``."""
    rows = stored(vector(statistics(docs)), "quality-statistics")
    est = estimate(rows.where("not base_failed"), p)
    k = len(X)
    inside = chi2_quantile(p.keep, k)
    widen = p.keep / chi2_cdf(inside, k + 2)       # the nearest rows understate the covariance by this factor
    far = _distance(rows.where("not base_failed"), est).withColumn("d2", F.col("d2") / widen)
    both = far.unionByName(rows.where("base_failed").withColumn("d2", F.lit(None).cast("double")))
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       (~F.col("base_failed") & F.coalesce(F.col("d2") <= chi2_quantile(p.cutoff, k), F.lit(False))).alias("kept"),
                       F.round("d2", 6).alias("d2"))
