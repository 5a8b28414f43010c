"""Ranked lexical search by pipelined term partitioning.

``build`` writes an inverted index: a task cuts its documents into blocks of
``block_docs`` documents at most, and a block has one row for each term (the
documents' ordinals in the block and the term's occurrences in them) and a
head row with ids and lengths.  Nothing is shuffled for it.

``search`` deals the terms of the items to owners by document frequency, the
rarest first.  Items travel in bundles of ``bundle`` items: for each block, a
bundle's row carries sparse accumulators (item, document, score) through the
owners' stages one after the other.  A stage is a cogroup of the bundles with
the postings of its owner's terms; it adds integer contributions and hands the
bundle on.  After the last stage the best of each block go to the final
selection.

Between stages an accumulator goes if its score and all that later owners
could add stay below the ``k``-th best score the item already has in that
block: such a document cannot be among the ``k`` best, so results are exact.
Frequent terms, which come last, then meet few accumulators.

A group of a cogroup is one block and one bundle, so its size is bounded by
``block_docs``, ``block_terms`` and ``bundle`` (a longer document is a block of
its own), however frequent a term is and however many documents share a text.

Terms, weights and scores are those of the contract: ``w = floor(1000 ln((2 N
+ 2) / (2 df + 1)))``, ``m = 25 + (75 n N) div L``, and a term adds ``w
((10^9 tf) div (1000 tf + 8 m))`` for each time the item has it.

Defined results: null and empty texts have no terms, and neither documents
nor items without terms appear; every row is a document or an item of its own,
so repeated rows are ranked, or answered, each; equal scores are ordered by
ascending ``doc_id``, null ids last; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, stored

TOP = 1_000_000            # no term adds more than its weight times this: 10^9 tf div (1000 tf + 8 m)


@dataclass(frozen=True)
class Params:
    k: int = 10
    block_docs: int = 4096
    block_terms: int = 1_000_000
    bundle: int = 256
    owners: tuple[float, ...] = (0.001, 0.01, 0.1)     # shares of the documents where the next owner's terms begin


#: Bytes that belong to no term become spaces, A-Z their small letters.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


# -- index ----------------------------------------------------------------------

BLOCK = "block long, term binary, df long, total long, docs binary, tfs binary, ids array<long>"


def numbers() -> dict:
    """Gives each new term the next number."""
    number: dict = defaultdict()
    number.default_factory = number.__len__
    return number


def invert(number: dict, texts: list[np.ndarray]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Terms in order, where each one's postings begin, ordinals and occurrences."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.concatenate(texts) if len(texts) else np.zeros(0, np.int32)
    names = sorted(number)
    rank = np.empty(len(names), np.int64)
    rank[[number[t] for t in names]] = np.arange(len(names))
    keys, tf = np.unique(rank[flat] * len(texts) + np.repeat(np.arange(len(texts)), sizes), return_counts=True)
    term, doc = np.divmod(keys, max(1, len(texts)))
    return names, np.searchsorted(term, np.arange(len(names) + 1)), doc, tf


def build(docs: DataFrame, path: str, p: Params = Params()) -> None:
    """The index of ``doc_id, text`` below ``path``."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 32
        number, ids, texts, size = numbers(), [], [], 0

        def packed(values: np.ndarray, kind: str, bounds: np.ndarray) -> pa.Array:
            data = np.ascontiguousarray(values, kind)
            at = (bounds * data.itemsize).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])

        def flush():
            names, bounds, doc, tf = invert(number, texts)
            lens = np.array([len(t) for t in texts], np.int64)
            one = np.array([0, len(texts)])
            yield pa.RecordBatch.from_arrays([
                pa.array([block]), pa.array([None], pa.binary()), pa.array([int((lens > 0).sum())]), pa.array([int(lens.sum())]),
                pa.array([None], pa.binary()), packed(lens, "<i8", one), pa.array([ids], pa.list_(pa.int64()))], NAMES)
            for a in range(0, len(names), 20_000):
                z = min(a + 20_000, len(names))
                own = bounds[a:z + 1]
                yield pa.RecordBatch.from_arrays([
                    pa.array([block] * (z - a)), pa.array(names[a:z], pa.binary()), pa.array(np.diff(own)),
                    pa.array(np.add.reduceat(tf, own[:-1]) if z > a else []), packed(doc[own[0]:own[-1]], "<u4", own - own[0]),
                    packed(tf[own[0]:own[-1]], "<u4", own - own[0]), pa.nulls(z - a, pa.list_(pa.int64()))], NAMES)

        NAMES = [c.split()[0] for c in BLOCK.split(", ")]
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = terms(t)
                if texts and (len(texts) >= p.block_docs or size + len(words) > p.block_terms):
                    yield from flush()
                    block, number, ids, texts, size = block + 1, numbers(), [], [], 0
                ids.append(i)
                texts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                size += len(words)
        if texts:
            yield from flush()

    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
         .mapInArrow(run, BLOCK).write.parquet(path))


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK).parquet(path)


# -- items ------------------------------------------------------------------------

def item_terms(items: DataFrame, p: Params) -> DataFrame:
    """``bundle, slot, term, qtf`` of ``q, text``."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            rows = [(q // p.bundle, q % p.bundle, t, n) for q, text in zip(*(c.to_pylist() for c in b.columns)) for t, n in Counter(terms(text)).items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, (pa.int64(), pa.int32(), pa.binary(), pa.int64()))],
                                             ["bundle", "slot", "term", "qtf"])
    return (items.select("q", F.col("text").cast("binary").alias("text"))
                 .mapInArrow(run, "bundle long, slot int, term binary, qtf long"))


def weigh(index: DataFrame, wanted: DataFrame, n_docs: int, p: Params) -> DataFrame:
    """``bundle, term, w, stage, slots, qtfs``: what each term gives to whom, and its owner."""
    words = index.where("term is not null").select("term", "df").join(wanted.select("term").distinct(), "term", "left_semi")
    df = words.groupBy("term").agg(F.sum("df").alias("df"))
    stage = sum(((F.col("df") > share * n_docs).cast("int") for share in p.owners), F.lit(0))
    w = F.floor(1000 * F.log((F.lit(2 * n_docs + 2.0)) / (2 * F.col("df") + 1))).cast("long")
    # a bundle has at most ``bundle`` items, so these lists are bounded
    lists = wanted.groupBy("bundle", "term").agg(F.sort_array(F.collect_list(F.struct("slot", "qtf"))).alias("x"))
    return lists.join(df, "term").select("bundle", "term", w.alias("w"), stage.alias("stage"), F.col("x.slot").alias("slots"), F.col("x.qtf").alias("qtfs"))


# -- stages -------------------------------------------------------------------------

ROW = "bundle long, block long, ids array<long>, lens binary, rest binary, at binary, score binary"


def kth(table: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th best of each row."""
    n = table.shape[1]
    return np.partition(table, n - k, axis=1)[:, n - k] if n >= k else np.zeros(len(table), np.int64)


def advance(stage: int, n_docs: int, n_terms: int, p: Params):
    """One owner's work on one bundle and block."""
    def run(bundles, postings):
        import pandas as pd
        out = bundles.copy()
        for row, b in enumerate(bundles.itertuples(index=False)):
            lens = np.frombuffer(b.lens, "<i8")
            m = 25 + 75 * lens * n_docs // n_terms
            table = np.zeros((p.bundle, len(lens)), np.int64)
            table.reshape(-1)[np.frombuffer(b.at, "<i8")] = np.frombuffer(b.score, "<i8")
            for w, slots, qtfs, docs, tfs in zip(*(postings[c] for c in ("w", "slots", "qtfs", "docs", "tfs"))):
                doc, tf = np.frombuffer(docs, "<u4"), np.frombuffer(tfs, "<u4").astype(np.int64)
                gain = w * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                for slot, qtf in zip(slots, qtfs):
                    table[slot, doc] += qtf * gain
            rest = np.frombuffer(b.rest, "<i8").reshape(p.bundle, -1)[:, stage]
            table[table + rest[:, None] < kth(table, p.k)[:, None]] = 0
            at = np.flatnonzero(table)
            out.iat[row, 5], out.iat[row, 6] = at.astype("<i8").tobytes(), table.reshape(-1)[at].astype("<i8").tobytes()
        return pd.DataFrame(out)
    return run


def best(p: Params):
    """``q, doc_id, score``: the ``k`` best of each item in each block."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            for r in b.to_pylist():
                at, score = np.frombuffer(r["at"], "<i8"), np.frombuffer(r["score"], "<i8")
                slot, doc = np.divmod(at, max(1, len(r["ids"])))
                ids = np.array([i or 0 for i in r["ids"]], np.int64)
                null = np.array([i is None for i in r["ids"]], bool)
                order = np.lexsort((ids[doc], null[doc], -score, slot))
                slot, doc, score = slot[order], doc[order], score[order]
                place = np.arange(len(slot)) - np.searchsorted(slot, slot)
                keep = place < p.k
                yield pa.RecordBatch.from_arrays([pa.array(r["bundle"] * p.bundle + slot[keep]), pa.array(ids[doc[keep]], mask=null[doc[keep]]),
                                                  pa.array(score[keep])], ["q", "doc_id", "score"])
    return run


def search(index: DataFrame, items: DataFrame, p: Params = Params()) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item."""
    spark = items.sparkSession
    items = stored(items.select(F.monotonically_increasing_id().alias("q"), "item_id", "text"), "search-items")
    heads = index.where("term is null").select("block", "df", "total", "ids", F.col("tfs").alias("lens"))
    n_docs, n_terms = heads.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    wanted = stored(item_terms(items, p), "search-terms")
    plan = stored(weigh(index, wanted, n_docs, p), "search-plan")
    posts = stored(index.where("term is not null").select("block", "term", "docs", "tfs").join(plan, "term"), "search-postings", "stage")

    # What the owners after each stage could still add, for each item of a bundle.
    stages = len(p.owners) + 1
    most = (plan.select("bundle", "stage", "w", F.explode(F.arrays_zip("slots", "qtfs")).alias("x"))
                .groupBy("bundle", "x.slots", "stage").agg(F.sum(F.col("w") * F.col("x.qtfs") * TOP).alias("most"))
                .groupBy("bundle").agg(F.collect_list(F.struct("slots", "stage", "most")).alias("most")))
    pairs = posts.select("bundle", "block").distinct()
    start = pairs.join(heads, "block").join(most, "bundle").select("bundle", "block", "ids", "lens", "most")

    def begin(batches):
        import pyarrow as pa
        for b in batches:
            rest = []
            for pairs in b.column("most").to_pylist():
                table = np.zeros((p.bundle, stages), np.int64)
                for x in pairs:
                    table[x["slots"], :x["stage"]] += x["most"]
                rest.append(table.astype("<i8").tobytes())
            none = pa.array([b""] * len(rest), pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("bundle", "block", "ids", "lens")), pa.array(rest, pa.binary()), none, none],
                                             ["bundle", "block", "ids", "lens", "rest", "at", "score"])

    rows = start.mapInArrow(begin, ROW)
    for stage in range(stages):
        own = posts.where(F.col("stage") == stage).select("bundle", "block", "w", "slots", "qtfs", "docs", "tfs")
        rows = rows.groupBy("bundle", "block").cogroup(own.groupBy("bundle", "block")).applyInPandas(advance(stage, n_docs, n_terms, p), ROW)
    found = rows.select("bundle", "ids", "at", "score").mapInArrow(best(p), "q long, doc_id long, score long")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k)
    return ranked.join(items.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, p: Params = Params(), path: str | None = None) -> DataFrame:
    """Index all documents, then search."""
    path = path or scratch(docs.sparkSession, "search-index")
    build(docs, path, p)
    return search(load(docs.sparkSession, path), items, p)
