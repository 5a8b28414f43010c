"""URL filters: rules first, then naive Bayes over segmented names.

Names like ``freebets`` are split into words by a unigram Viterbi search.
Word counts come from all page titles, from path words and from name parts
already set apart by hyphens; ``seeds`` join with a pseudo-count.  Each
distinct name looks up its substrings by a join, so the word table is never
broadcast and may grow with the corpus.  Substrings of up to ``longest_word``
letters are looked up: all of them in a valid host label, which has 63 at most.

The words of host and path then go through a multinomial naive Bayes
classifier.  Its training labels are distant: a URL with a seed word is of
the class block, any other of the class allow, over all URLs.  A word that
keeps company with seeds thus blocks names without one.  Counts and
scores are taken per distinct (host, path with digits folded), so hot hosts
shrink to one row before anything is joined.

Defined results: a null url, or one without ``://``, has an empty host and
path and no words, and gets the more frequent class; repeated rows stay; html
may be null; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# Words of names that filter lists block (advertising, gambling, adult, spam, drugs, malware).
SEEDS = ("ads", "advert", "adserver", "banner", "popup", "tracker", "tracking", "track", "casino", "casinos", "poker", "bet",
         "bets", "betting", "slots", "jackpot", "lottery", "adult", "porn", "xxx", "sex", "nude", "escort", "spam", "pills",
         "viagra", "cialis", "pharma", "malware", "phishing", "warez", "torrent", "payday", "loans")

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))


@dataclass(frozen=True)
class Params:
    rules: tuple = RULES
    seeds: tuple = SEEDS
    longest_word: int = 63         # longest label of a host name, so every substring of a valid one is a candidate
    seed_count: int = 50           # pseudo-count of a seed among the words
    alpha: float = 0.1


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def apply_rules(host: Column, path: Column, rules=RULES) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(h + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def names(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def word_counts(pages: DataFrame, urls: DataFrame, p: Params) -> DataFrame:
    """``word, n`` from titles, path words, hyphenated name parts and seeds."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    hyphen = F.flatten(F.transform(F.filter(F.split("host", r"\."), lambda x: x.contains("-")), lambda x: F.split(x, "-")))
    found = pages.select(F.explode(names(F.coalesce(title, F.lit("")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    more = urls.select(F.explode(F.concat(names(F.col("sig")), hyphen)).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    seeds = pages.sparkSession.createDataFrame([(s, p.seed_count) for s in p.seeds], "word string, n long")
    return (found.unionByName(more).unionByName(seeds).where("word <> '' and not word rlike '[0-9]'")
                 .groupBy("word").agg(F.sum("n").alias("n")))


def viterbi(name: str, hits: list[tuple[int, int, int]], total: int) -> list[str]:
    """Most probable split; ``hits`` are the words found, as (start, end, count).

    A stretch no word covers costs ten times more for each character.  ``free``
    is the best split that ends inside such a stretch, which began at ``since``,
    so the work is linear in the name and its hits.
    """
    n, unknown, step = len(name), -math.log(total), math.log(10)
    ends: dict[int, list[tuple[int, int]]] = {}
    for i, j, c in hits:
        ends.setdefault(j, []).append((i, c))
    best, back = [0.0] * (n + 1), [0] * (n + 1)
    free, since = -math.inf, 0
    for j in range(1, n + 1):
        if best[j - 1] + unknown > free:
            free, since = best[j - 1] + unknown, j - 1
        free -= step
        best[j], back[j] = free, since
        for i, c in ends.get(j, ()):
            s = best[i] + math.log(c / total)
            if s > best[j]:
                best[j], back[j] = s, i
    out = []
    while n:
        out.append(name[back[n]:n])
        n = back[n]
    return out[::-1]


def segment(found: DataFrame, words: DataFrame, p: Params) -> DataFrame:
    """``name, parts`` for distinct ``name`` values."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"] + 1
    i, j = F.col("i"), F.col("j")
    spans = (found.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("i"))
                  .select("name", "i", F.explode(F.sequence(i, F.least(F.length("name"), i + p.longest_word - 1))).alias("j"))
                  .select("name", "i", "j", F.substr("name", i, j - i + 1).alias("word")))
    hits = (spans.join(words, "word").groupBy("name")
                 .agg(F.collect_list(F.struct((i - 1).alias("i"), "j", "n")).alias("hits")))     # a name's substrings at most
    rows = found.join(hits, "name", "left")

    def run(batches):
        import pyarrow as pa
        for b in batches:
            out = [viterbi(r["name"], [(h["i"], h["j"], h["n"]) for h in r["hits"] or []], total) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(out, pa.list_(pa.string()))], ["name", "parts"])

    return rows.mapInArrow(run, "name string, parts array<string>")


def bayes(urls: DataFrame, p: Params) -> DataFrame:
    """``urls (host, sig, n, tokens)`` with the log-odds of block as ``score``."""
    block = F.arrays_overlap("tokens", F.array(*[F.lit(s) for s in p.seeds])).cast("long")
    rows = urls.withColumn("b", F.col("n") * block).withColumn("a", F.col("n") - F.col("b"))
    tokens = rows.select(F.explode("tokens").alias("token"), "a", "b")
    table = tokens.groupBy("token").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    t = table.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("v")).first()
    c = rows.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    low = [math.log((t[k] or 0) + p.alpha * (t["v"] + 1)) for k in ("a", "b")]
    weight = table.select("token", (F.log(F.col("b") + p.alpha) - F.lit(low[1]) - F.log(F.col("a") + p.alpha) + F.lit(low[0])).alias("w"))
    prior = math.log((c["b"] or 0) + p.alpha) - math.log((c["a"] or 0) + p.alpha)
    sums = (urls.select("host", "sig", F.explode("tokens").alias("token")).join(weight, "token")
                .groupBy("host", "sig").agg(F.sum("w").alias("w")))
    return urls.join(sums, ["host", "sig"], "left").select("host", "sig", (F.lit(prior) + F.coalesce("w", F.lit(0.0))).alias("score"))


def judge(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every page."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    sig = F.regexp_replace(F.lower("path"), "[0-9]+", "0").alias("sig")
    urls = stored(rows.select("host", sig).groupBy("host", "sig").agg(F.count(F.lit(1)).alias("n")), "url-names")
    words = stored(word_counts(pages, urls, p), "url-words")
    hosts = urls.select("host").distinct()
    split = hosts.select("host", F.posexplode(names(F.col("host"))).alias("at", "name"))
    cut = segment(split.select("name").distinct(), words, p)
    tokens = (split.join(cut, "name").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "parts"))).alias("x"))
                   .select("host", F.flatten(F.col("x.parts")).alias("host_tokens")))
    urls = urls.join(tokens, "host", "left").withColumn("tokens", F.concat(F.coalesce("host_tokens", F.array().cast("array<string>")), names(F.col("sig"))))
    scores = stored(bayes(stored(urls.select("host", "sig", "n", "tokens"), "url-tokens"), p), "url-scores")
    rule = apply_rules(F.col("host"), F.col("path"), p.rules)
    out = rows.withColumn("sig", sig).join(scores, ["host", "sig"]).withColumn("_r", rule)
    return out.select("page_id", "host", "path", F.col("_r.rule").alias("rule"),
                      F.coalesce(F.col("_r.verdict"), F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")
