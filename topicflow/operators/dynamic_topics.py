"""Topics linked over time slices (M3, the coupled form).

A state-space model: the log weight of each (topic, term) walks from slice to
slice with variance ``drift``, and the words of a slice's documents are drawn
from its weights.  The fit alternates

* an E-step over documents: a document's mixture is found by fixed-point rounds
  against the weights of its slice, and its words hand expected counts back;
* an M-step over terms: expected counts are Poisson observations of the walk.
  Each is linearised at the present weight, and a forward (Kalman) and a
  backward (Rauch-Tung-Striebel) pass over the slices give the new weights.

Weights and counts are tables by (slice, term); a term's row holds ``k`` values
for each slice, so neither the vocabulary nor the model ever reaches the driver,
only ``slices x k`` totals do.  Documents are packed into blocks once; in each
iteration only the weights of a block's terms and its sums per term move.  A
block is one unit of work.  All slices
start from one seeded table, so topic numbers mean the same in every slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pinned


@dataclass(frozen=True)
class Params:
    k: int = 10
    iterations: int = 10
    warm: int = 5                # first iterations with one table of weights for all slices
    rounds: int = 15             # fixed-point rounds of a document's mixture
    alpha: float = 0.1           # pseudo count of each topic in a document
    eta: float = 0.05            # pseudo count of each term in a topic
    drift: float = 0.05          # variance of a log weight's step; 0: one table for all slices
    passes: int = 6              # linearisations of a smoothing
    seed: int = 0
    block: int = 500_000         # rows (document, term) held by a task at a time, or one document


# -- numerics -------------------------------------------------------------------

def mixture(n: np.ndarray, phi: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Mixture of one document (``n``: counts, ``phi``: terms x topics) and its expected counts."""
    theta = np.full(phi.shape[1], 1.0 / phi.shape[1])
    for _ in range(p.rounds):
        share = phi * theta
        share /= share.sum(1, keepdims=True)
        theta = n @ share + p.alpha
        theta /= theta.sum()
    share = phi * theta
    return theta, n[:, None] * share / share.sum(1, keepdims=True)


def mixtures(n: np.ndarray, phi: np.ndarray, at: np.ndarray, p: Params) -> np.ndarray:
    """Expected counts of many documents at once, as ``mixture`` finds them: the terms of one begin at each of ``at``."""
    doc = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(n))))
    n = n[:, None]
    theta = np.full((len(at), phi.shape[1]), 1.0 / phi.shape[1])
    for _ in range(p.rounds):
        share = phi * theta[doc]
        share *= n / share.sum(1, keepdims=True)
        theta = np.add.reduceat(share, at) + p.alpha
        theta /= theta.sum(1, keepdims=True)
    share = phi * theta[doc]
    return share * (n / share.sum(1, keepdims=True))


def smooth(counts: np.ndarray, totals: np.ndarray, p: Params, n_terms: int) -> np.ndarray:
    """Log weights (terms x slices x topics) from expected counts of that shape and ``totals`` (slices x topics)."""
    y = counts + p.eta
    exposure = totals + p.eta * n_terms
    if not p.drift:
        pooled = np.log(y.sum(1, keepdims=True)) - np.log(exposure.sum(0))
        return np.repeat(pooled, counts.shape[1], 1)
    beta = np.log(y) - np.log(exposure)
    slices = counts.shape[1]
    if slices == 1:
        return beta
    for _ in range(p.passes):
        rate = exposure * np.exp(beta)                                   # Poisson rate, and weight of the observation
        z = beta + np.clip((y - rate) / rate, -2, 2)
        mean, var = np.empty_like(beta), np.empty_like(beta)
        mean[:, 0], var[:, 0] = z[:, 0], 1 / rate[:, 0]
        for t in range(1, slices):                                       # forward
            ahead = var[:, t - 1] + p.drift
            gain = ahead / (ahead + 1 / rate[:, t])
            mean[:, t] = mean[:, t - 1] + gain * (z[:, t] - mean[:, t - 1])
            var[:, t] = (1 - gain) * ahead
        for t in range(slices - 2, -1, -1):                              # backward
            mean[:, t] += var[:, t] / (var[:, t] + p.drift) * (mean[:, t + 1] - mean[:, t])
        beta = mean
    return beta


# -- Spark ------------------------------------------------------------------------

def bags(long: DataFrame, slice_col: str, id_col: str = "doc_id") -> DataFrame:
    """``id, slice, term, n`` of rows ``id, slice, term``; slices are numbers from 0 on."""
    return (long.select(F.col(id_col).alias("id"), F.col(slice_col).cast("int").alias("slice"), "term")
                .groupBy("id", "slice", "term").agg(F.count(F.lit(1)).alias("n")))


def _start(terms: DataFrame, p: Params) -> DataFrame:
    """``term, w``: a term's frequency, bent by a seeded number for each topic."""
    bend = F.transform(F.sequence(F.lit(0), F.lit(p.k - 1)), lambda k: 0.5 + F.pmod(F.xxhash64("term", k, F.lit(p.seed)), F.lit(1 << 20)) / float(1 << 20))
    return terms.select("term", F.transform(bend, lambda b: b * F.col("n")).alias("w"))


def _normalised(weights: DataFrame, p: Params) -> DataFrame:
    """``slice, term, phi``: weights that sum to one in each slice and topic."""
    sums = weights.groupBy("slice").agg(F.array(*[F.sum(F.col("w")[k]) for k in range(p.k)]).alias("s"))      # slices x k numbers
    return weights.join(F.broadcast(sums), "slice").select("slice", "term", F.zip_with("w", "s", lambda a, b: a / b).alias("phi"))


def _blocks(bag: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Documents of a slice in blocks of about ``p.block`` rows of ``bag``, dealt by id.

    The first table has a row for each block: where its documents begin (``at``), and for each of its
    rows the place of the term in ``terms`` and the count.  The second is ``slice, block, i, term``.
    A block asks for the weights of its terms once, however many of its documents hold them.
    """
    def pack(key, rows):
        import pyarrow as pa
        doc = rows.column("id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        term = rows.column("term").combine_chunks().dictionary_encode()
        names = np.array(term.dictionary.to_pylist(), object)
        order = np.argsort(names)
        place = np.empty(len(names), np.int32)
        place[order] = np.arange(len(names), dtype=np.int32)
        i = place[term.indices.to_numpy()]
        by = np.lexsort((i, doc))
        at = np.flatnonzero(np.diff(doc[by], prepend=-1)).astype(np.int32)
        cells = [[key[0].as_py()], [key[1].as_py()], [at], [i[by]], [rows.column("n").to_numpy()[by]], [names[order]]]
        return pa.table([pa.array(c, f.type) for c, f in zip(cells, layout)], schema=layout)

    import pyarrow as pa
    layout = pa.schema([("slice", pa.int32()), ("block", pa.int64()), ("at", pa.list_(pa.int32())), ("i", pa.list_(pa.int32())),
                        ("n", pa.list_(pa.int64())), ("terms", pa.list_(pa.string()))])
    bag = bag.where("slice is not null and term is not null")
    n, slices = bag.agg(F.count(F.lit(1)), F.countDistinct("slice")).first()
    many = int(max(n / p.block, bag.sparkSession.sparkContext.defaultParallelism) / max(slices, 1)) + 1
    rows = bag.select("id", F.col("slice").cast("int").alias("slice"), "term", F.col("n").cast("long").alias("n"), F.pmod(F.xxhash64("id"), F.lit(many)).alias("block"))
    blocks = pinned(rows.groupBy("slice", "block").applyInArrow(pack, "slice int, block long, at array<int>, i array<int>, n array<long>, terms array<string>"))
    return blocks, pinned(blocks.select("slice", "block", F.posexplode("terms").alias("i", "term")))


def _expected(bag: DataFrame, phi: DataFrame, p: Params) -> DataFrame:
    """``slice, term, c``: expected counts of each topic."""
    return _expected_of(*_blocks(bag, p), phi, p)


def _expected_of(blocks: DataFrame, terms: DataFrame, phi: DataFrame, p: Params) -> DataFrame:
    """The same, of blocks; terms without weights are left out."""
    columns = [f"c{k}" for k in range(p.k)]

    def run(block, weights):
        import pyarrow as pa
        total = np.zeros((0, p.k))
        known, names = np.zeros(0, bool), pa.array([], pa.string())
        if block.num_rows and weights.num_rows:
            cell = lambda c: block.column(c).chunk(0).flatten()
            names, at, i, n = cell("terms"), *(cell(c).to_numpy() for c in ("at", "i", "n"))
            w, known = np.zeros((len(names), p.k)), np.zeros(len(names), bool)
            here = weights.column("i").to_numpy()
            known[here] = True
            for k, c in enumerate(columns):
                w[here, k] = weights.column(c).to_numpy()
            doc = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(i))))[known[i]]
            i, n = i[known[i]], n[known[i]].astype(float)
            at = np.flatnonzero(np.diff(doc, prepend=-1))
            parts = [slice(at[a], at[a + 256] if a + 256 < len(at) else len(i)) for a in range(0, len(at), 256)]
            found = np.concatenate([mixtures(n[x], w[i[x]], at[256 * j:256 * (j + 1)] - x.start, p) for j, x in enumerate(parts)])
            total = np.stack([np.bincount(i, found[:, k], len(names)) for k in range(p.k)], 1)
        at_slice = block.column("slice")[0].as_py() if block.num_rows else 0
        kept = np.flatnonzero(known)
        return pa.table([pa.array(np.full(len(kept), at_slice, np.int32)), names.take(pa.array(kept)), *[pa.array(total[kept, k]) for k in range(p.k)]],
                        names=["slice", "term", *columns])

    asked = terms.join(phi, ["slice", "term"]).select("slice", "block", "i", *[F.col("phi")[k].alias(c) for k, c in enumerate(columns)])
    given = blocks.groupBy("slice", "block").cogroup(asked.groupBy("slice", "block")).applyInArrow(run, "slice int, term string, " + ", ".join(f"{c} double" for c in columns))
    return given.groupBy("slice", "term").agg(F.array(*[F.sum(c) for c in columns]).alias("c"))


def _weights(expected: DataFrame, slices: int, n_terms: int, p: Params) -> DataFrame:
    """``slice, term, w`` by smoothing each term over the slices."""
    totals = np.zeros((slices, p.k))
    for r in expected.groupBy("slice").agg(F.array(*[F.sum(F.col("c")[k]) for k in range(p.k)]).alias("s")).collect():      # slices x k numbers
        totals[r["slice"]] = r["s"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            counts = np.zeros((b.num_rows, slices, p.k))
            x = b.column("x")
            at_slice, c = x.flatten().flatten()
            counts[x.value_parent_indices().to_numpy(), at_slice.to_numpy()] = c.flatten().to_numpy().reshape(-1, p.k)
            w = np.exp(smooth(counts, totals, p, n_terms))
            each = np.arange(b.num_rows).repeat(slices)
            ends = pa.array(np.arange(len(each) + 1, dtype=np.int32) * p.k)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(slices, dtype=np.int32), b.num_rows)), b.column("term").take(pa.array(each)),
                                              pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], ["slice", "term", "w"])

    rows = expected.groupBy("term").agg(F.collect_list(F.struct("slice", "c")).alias("x"))             # a row for each slice at most
    return rows.mapInArrow(run, "slice int, term string, w array<double>")


def fit(bag: DataFrame, slices: int, p: Params = Params()) -> DataFrame:
    """``slice, term, phi``: the weights of the ``k`` topics in each of the slices 0, 1, ... of ``id, slice, term, n``."""
    bag = pinned(bag)
    blocks = _blocks(bag, p)
    terms = bag.groupBy("term").agg(F.sum("n").cast("double").alias("n"))
    start = _start(terms, p).select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "term", "w")
    phi = pinned(_normalised(start, p))
    n_terms = terms.count()
    for i in range(p.warm + p.iterations):
        now = Params(**{**p.__dict__, "drift": 0.0}) if i < p.warm else p
        phi = pinned(_normalised(pinned(_weights(pinned(_expected_of(*blocks, phi, p)), slices, n_terms, now)), p))
    return phi


def top_terms(phi: DataFrame, top: int = 10) -> DataFrame:
    """``slice, topic, rank, term, weight``."""
    from .ctfidf import top_words
    long = phi.select("slice", "term", F.posexplode("phi").alias("topic", "weight"))
    return top_words(long.withColumn("topic", F.col("topic").cast("long")), ["slice", "topic"], top)


def held_out(bag: DataFrame, phi: DataFrame, p: Params = Params()) -> DataFrame:
    """``id, slice, n, log_likelihood``: mixtures found from one half of a document's terms, judged on the other.

    A term's half is chosen by its hash; terms without weights are left out."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            rows = []
            for row in b.to_pylist():
                n, w, half = (np.array([r[c] for r in row["x"]]) for c in ("n", "phi", "half"))
                if half.any() and not half.all():
                    theta, _ = mixture(n[half].astype(float), w[half], p)
                    rows.append((row["id"], row["slice"], int(n[~half].sum()), float(n[~half] @ np.log(w[~half] @ theta))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema=schema)

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    kind = bag.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("slice", pa.int32()), ("n", pa.int64()), ("log_likelihood", pa.float64())])
    rows = (bag.join(phi, ["slice", "term"]).withColumn("half", F.pmod(F.xxhash64("term"), F.lit(2)) == 0)
               .groupBy("id", "slice").agg(F.collect_list(F.struct("n", "phi", "half")).alias("x")))
    return rows.mapInArrow(run, f"id {kind.simpleString()}, slice int, n long, log_likelihood double")
