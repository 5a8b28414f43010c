"""Token counts from an exact length histogram.

Documents are encoded once and aggregated by their length in tokens, so all
later questions run on a table with one row for each distinct length.  Prefix
and suffix sums over it answer totals, quantiles and truncated totals for
every context limit.  The sums are taken in two steps, within and across
ranges of ``bucket`` lengths, so no task holds the whole histogram.

Defined results: null text has no tokens; repeated rows count each; an empty
table has an empty histogram; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import blocks, load, patterns


@dataclass(frozen=True)
class Params:
    ranks: str = "byte_bpe_50k.tiktoken"           # a file of public_tokenizers, or a path
    memo: int = 800_000
    bucket: int = 1024


class Counter:
    """Token counts by the tiktoken library; pieces between single spaces are
    counted once and looked up."""

    def __init__(self, p: Params):
        import public_tokenizers
        import tiktoken
        self.p, self.known = p, {}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load(p.ranks).ranks, special_tokens={})
        self.loose = patterns()[1]

    def __call__(self, texts: list[str | None]) -> list[int]:
        cut = []
        for t in texts:
            if not t or self.loose.search(t):
                cut.append([t] if t else [])
            else:
                first, *rest = t.split(" ")
                cut.append([first, *[" " + x for x in rest]])
        if len(self.known) > self.p.memo:
            self.known.clear()
        new = list(set().union(*(c for c in cut if len(c) > 1)).difference(self.known))     # a whole text may be another's first piece
        self.known.update(zip(new, map(len, map(self.encoding.encode_ordinary, new))))
        get = self.known.__getitem__
        return [len(self.encoding.encode_ordinary(c[0])) if len(c) == 1 else sum(map(get, c)) for c in cut]


@lru_cache(maxsize=1)
def counter(p: Params) -> Counter:
    return Counter(p)


def lengths(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id, n_tokens`` of every document."""
    def run(batches):
        import pyarrow as pa
        count = counter(p)
        for rows in blocks(batches, 1, 4_000_000):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(count([r[1] for r in rows]), pa.int64())],
                                             ["doc_id", "n_tokens"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def histogram(lens: DataFrame) -> DataFrame:
    """``length, n_docs``."""
    return lens.groupBy(F.col("n_tokens").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))


def sums(hist: DataFrame, bucket: int = Params.bucket) -> DataFrame:
    """The histogram with, for a context limit equal to each length:
    ``docs_within`` and ``tokens_within`` (documents up to the limit),
    ``docs_over`` and ``tokens_over`` (longer ones, whole), ``truncated_total``
    (tokens left when every document is cut at the limit) and ``share_within``."""
    h = hist.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("_b", F.floor(F.col("length") / bucket))
    across = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)        # one row a bucket
    total = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = h.groupBy("_b").agg(F.sum("n_docs").alias("n"), F.sum("tokens").alias("t"))
    heads = heads.select("_b", (F.sum("n").over(across) - F.col("n")).alias("n0"), (F.sum("t").over(across) - F.col("t")).alias("t0"),
                         F.sum("n").over(total).alias("n_all"), F.sum("t").over(total).alias("t_all"))
    inner = Window.partitionBy("_b").orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = (F.col("n0") + F.sum("n_docs").over(inner)).alias("docs_within"), (F.col("t0") + F.sum("tokens").over(inner)).alias("tokens_within")
    out = h.join(heads, "_b").select("length", "n_docs", *within, "n_all", "t_all")
    out = out.withColumn("docs_over", F.col("n_all") - F.col("docs_within")).withColumn("tokens_over", F.col("t_all") - F.col("tokens_within"))
    return out.select("length", "n_docs", "docs_within", "tokens_within", "docs_over", "tokens_over",
                      (F.col("tokens_within") + F.col("length") * F.col("docs_over")).alias("truncated_total"),
                      (F.col("docs_within") / F.col("n_all")).alias("share_within"))


def at_limit(table: DataFrame, limit: int) -> DataFrame:
    """One row for any context limit, from the greatest length up to it."""
    below = table.where(F.col("length") <= limit)
    row: list[Column] = [F.max_by(c, "length").alias(c) for c in ("docs_within", "tokens_within", "docs_over", "tokens_over")]
    first = table.agg(F.min_by(F.col("docs_within") + F.col("docs_over"), "length").alias("n"), F.min_by(F.col("tokens_within") + F.col("tokens_over"), "length").alias("t"))
    out = below.agg(*row).crossJoin(first)                         # two single rows
    zero = lambda c, d: F.coalesce(F.col(c), F.col(d) if d else F.lit(0), F.lit(0)).alias(c)
    out = out.select(zero("docs_within", None), zero("tokens_within", None), zero("docs_over", "n"), zero("tokens_over", "t"))
    return out.select(F.lit(limit).cast("long").alias("limit"), "*", (F.col("tokens_within") + F.lit(limit) * F.col("docs_over")).alias("truncated_total"))


def quantile(table: DataFrame, q: float) -> DataFrame:
    """The least length that at least a share ``q`` of the documents do not exceed."""
    return table.where(F.col("share_within") >= q).agg(F.min("length").alias("length"))


def token_counts(docs: DataFrame, p: Params = Params()) -> DataFrame:
    return sums(histogram(lengths(docs, p)), p.bucket)
