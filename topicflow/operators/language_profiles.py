"""T17 by letter profiles: smoothed n-gram counts per language, learned from rows with a language.

A word is padded with one space on each side and cut into grams of ``n``
letters.  ``learn`` counts the grams of every language (words are counted
first, so a gram is cut once per distinct word and language); ``classify``
scores each distinct word of the corpus once against the profile, joins the
scores with the counted words of the documents, and adds them up.

With add-one smoothing a gram of count c in a language of N grams weighs
``ln((c + 1) / (N + V))``, V being the distinct grams of the profile.  So only
seen grams need a join: a document of G grams scores
``sum(ln(c + 1)) - G * ln(N + V)``.  Weights are whole millionths, hence sums
do not depend on the order of rows.

Defined results: null languages and null tokens teach nothing; a document
without a word has null ``detected_lang`` and ``score``; equal scores go to the
first language code; rows of one id are one document; an empty profile detects
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vocab import explode_tokens

SCALE = 1_000_000


def grams(word: Column, n: int = 3) -> Column:
    """``array<string>``: the grams of a padded word; linear in its letters (a short word gives itself, padded)."""
    letters = F.split(F.concat(F.lit(" "), word, F.lit(" ")), "")

    def cut(a: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(a) - n, F.lit(0)))
        return F.transform(starts, lambda i: F.concat(*[F.coalesce(F.get(a, i + k), F.lit("")) for k in range(n)]))
    return F.transform(F.array(letters), cut)[0]


def word_counts(df: DataFrame, tokens: str, by: str) -> DataFrame:
    """``(by, term, c)``."""
    long = explode_tokens(df, (by,), tokens)
    return long.where(F.col("term") != "").groupBy(by, "term").agg(F.count(F.lit(1)).alias("c"))


def learn(df: DataFrame, lang: str = "lang", tokens: str = "tokens", n: int = 3) -> DataFrame:
    """``(lang, gram, c)``: how often each language has each gram."""
    words = word_counts(df.where(F.col(lang).isNotNull()), tokens, lang)
    cut = words.select(F.col(lang).alias("lang"), "c", F.explode(grams(F.col("term"), n)).alias("gram"))
    return cut.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _millionths(x: Column) -> Column:
    return F.round(F.log(x) * SCALE).cast("long")


def penalties(profile: DataFrame) -> DataFrame:
    """One row: the languages, each with the weight every gram costs there (as many entries as languages)."""
    v = profile.agg(F.count_distinct("gram").alias("v"))
    size = profile.groupBy("lang").agg(F.sum("c").alias("n"))
    cost = size.crossJoin(v).select("lang", _millionths(F.col("n") + F.col("v")).alias("cost"))      # one-row side
    return cost.agg(F.array_sort(F.collect_list(F.struct("lang", "cost"))).alias("langs"))


def classify(df: DataFrame, profile: DataFrame, id_col: str = "doc_id", tokens: str = "tokens", n: int = 3) -> DataFrame:
    """``(id_col, detected_lang, score)`` for every id; ``score`` is a log-likelihood."""
    words = word_counts(df, tokens, id_col)
    cut = words.select("term").distinct().select("term", F.posexplode(grams(F.col("term"), n)).alias("at", "gram"))
    seen = cut.join(profile.select("gram", "lang", _millionths(F.col("c") + 1).alias("w")), "gram")
    gain = (seen.groupBy("term", "lang").agg(F.sum("w").alias("w"))
                .groupBy("term").agg(F.collect_list(F.struct("lang", "w")).alias("gains")))
    size = F.greatest(F.char_length("term") + 3 - n, F.lit(1))
    # A word's grams count once: by its first language, or alone where no gram was seen.
    first = (F.col("x").isNull()) | (F.col("x.lang") == F.col("low"))
    met = words.join(gain.withColumn("low", F.array_min(F.transform("gains", lambda s: s["lang"]))), "term", "left").select(
        id_col, "c", "low", (F.col("c") * size).alias("g"), F.explode_outer("gains").alias("x"))
    part = met.groupBy(id_col, F.col("x.lang").alias("lang")).agg(
        F.sum(F.col("c") * F.col("x.w")).alias("w"), F.sum(F.when(first, F.col("g")).otherwise(0)).alias("g"))
    docs = part.groupBy(id_col).agg(
        F.sum("g").alias("g"),
        F.map_from_entries(F.collect_list(F.when(F.col("lang").isNotNull(), F.struct("lang", "w")))).alias("sums"))
    score = lambda l: F.coalesce(F.col("sums")[l["lang"]], F.lit(0)) - F.col("g") * l["cost"]
    scored = docs.crossJoin(F.broadcast(penalties(profile))).select(id_col, F.transform(       # one-row side
        "langs", lambda l: F.struct((-score(l)).alias("loss"), l["lang"].alias("lang"))).alias("all"))
    best = scored.select(id_col, F.array_min("all").alias("best"))                             # least loss, then first code
    best = best.select(id_col, F.col("best.lang").alias("detected_lang"), (-F.col("best.loss") / SCALE).alias("score"))
    ids = df.select(id_col).distinct()
    return ids.join(best, id_col, "left")
