"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the mean of its character n-gram vectors (hashed into buckets), a
passage the mean of its words, and a softmax on that mean gives the label.
Embeddings and softmax are trained jointly in numpy, so a misspelling nobody
has seen still scores through the n-grams it shares with known words.

A few words in a long text would vanish in one average, so the averages are
taken over passages of ``span`` words.  In training a passage has the label
of its document; a document's score is its highest passage, put on the
probability scale by a one-variable logistic fit on the sample documents.

The classifier is fitted on a bounded sample of labelled rows
(``per_class`` texts of each label, in hash order); scoring covers every row
and every passage.  Scoring needs one number per n-gram bucket, the bucket's
vector times the difference of the softmax weights, so the model sent to the
tasks is ``buckets`` doubles whatever the corpus size.

Defined results: null or empty text, and text without a word, score as a
passage at the bias; rows keep their multiplicity; extra columns are ignored;
without usable labels of both classes every score is the smoothed share of
label 1.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, unboxed

EDGE = " \t\r\n.,;:!?\"'()[]{}<>|*#$%&+=~`^_/\\-«»“”„‘’…–—¡¿"
PRIMES = (np.uint64(0x9E3779B1), np.uint64(0x85EBCA77))


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 17
    features: int = 16384          # buckets with a vector, the most frequent of the sample
    dim: int = 4
    ngrams: tuple = (3, 4, 5)
    span: int = 8                  # words in a passage
    per_class: int = 2000          # bounds of the labelled sample: rows of each label,
    max_chars: int = 4000          # and the length a text may have to be learned from
    steps: int = 160
    batch: int = 2048              # passages in a step
    rate: float = 0.05
    seed: int = 7


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """The rows no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def clean(token: str) -> str:
    return token.lower().strip(EDGE)


def subwords(words: list[str], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """``(word index, bucket)`` of every n-gram of ``<word>`` and of the word
    itself, ordered by word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wrapped = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(wrapped).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, wrapped), np.int64, len(wrapped))
    ends = np.cumsum(lens)
    owner = np.repeat(np.arange(len(words)), lens)
    left = ends[owner] - np.arange(len(codes))          # characters from here to the word's end
    at, ids = [np.arange(len(words))], [np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))]
    for n in p.ngrams:
        h = np.full(max(0, len(codes) - n + 1), n, np.uint64)
        for k in range(n):
            h = (h ^ codes[k:len(codes) - n + 1 + k]) * PRIMES[0]
            h ^= h >> np.uint64(29)
        h *= PRIMES[1]
        fits = np.flatnonzero(left[:len(h)] >= n)
        at.append(owner[fits])
        ids.append(h[fits] >> np.uint64(11))
    at, ids = np.concatenate(at), np.concatenate(ids) % np.uint64(p.buckets)
    order = np.argsort(at, kind="stable")
    return at[order], ids[order].astype(np.int64)


def passages(n: int, span: int) -> np.ndarray:
    """First words of the passages of ``n`` words; a short rest joins the last."""
    return np.arange(0, max(1, n - span // 2), span)


def _words(texts: list[str]) -> tuple[dict[str, int], list[np.ndarray]]:
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for t in text.split() if (w := clean(t))], np.int64) for text in texts]
    return index, [d[once(d)] for d in docs]


def once(x: np.ndarray) -> np.ndarray:
    """True where an entry differs from the one before: a run of one word counts once."""
    return np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)


def _sum(keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(keys, values[:, j], n) for j in range(values.shape[1])], 1)


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray            # softmax difference of each bucket's vector
    bias: float
    slope: float                   # from the highest passage to the log-odds of the document
    shift: float


def fit(texts: list[str], labels: list[int], p: Params = Params()) -> Model:
    """Joint training of embeddings and softmax with Adam on mini-batches."""
    label = np.array(labels, np.int64)
    share = (label.sum() + 1.0) / (len(label) + 2.0)
    index, docs = _words(texts)
    if len(set(labels)) < 2 or not index:
        return Model(np.zeros(p.buckets), 0.0, 0.0, float(np.log(share / (1 - share))))
    at, ids = subwords(list(index), p)
    uses = np.bincount(np.concatenate(docs), minlength=len(index))
    chosen = np.argsort(-np.bincount(ids, uses[at], p.buckets), kind="stable")[:p.features]
    place = np.full(p.buckets, -1)
    place[chosen] = np.arange(len(chosen))
    gram = 1.0 / np.bincount(at, minlength=len(index))
    known = place[ids] >= 0
    at, ids = at[known], place[ids[known]]
    first = np.searchsorted(at, np.arange(len(index) + 1))
    cut = [(x, y) for d, y in zip(docs, labels, strict=True) if len(d)
           for x in np.split(d, passages(len(d), p.span)[1:])]
    rng = np.random.default_rng(p.seed)
    theta = [rng.normal(0, 0.1, (len(chosen), p.dim)), rng.normal(0, 1, (p.dim, 2)), np.zeros(2)]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    order = np.zeros(0, np.int64)
    for step in range(1, p.steps + 1):
        if not len(order):
            order = rng.permutation(len(cut))
        part, order = [cut[k] for k in order[:p.batch]], order[p.batch:]
        y, size = np.array([x[1] for x in part]), np.array([len(x[0]) for x in part])
        used, word = np.unique(np.concatenate([x[0] for x in part]), return_inverse=True)
        bag, n = np.repeat(np.arange(len(part)), size), len(part)
        grams = first[used + 1] - first[used]
        spot = np.repeat(first[used] - np.cumsum(grams) + grams, grams) + np.arange(grams.sum())
        owner, feature = np.repeat(np.arange(len(used)), grams), ids[spot]
        emb, soft, bias = theta
        words = _sum(owner, emb[feature], len(used)) * gram[used, None]
        mean = _sum(bag, words[word], n) / size[:, None]
        z = mean @ soft + bias
        prob = np.exp(z - z.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        prob[np.arange(n), y] -= 1
        prob /= n
        back = _sum(word, (prob @ soft.T / size[:, None])[bag], len(used)) * gram[used, None]
        for k, g in enumerate((_sum(feature, back[owner], len(chosen)), mean.T @ prob, prob.sum(0))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            theta[k] -= p.rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-7)
    emb, soft, bias = theta
    buckets = np.zeros(p.buckets)
    buckets[chosen] = emb @ (soft[:, 1] - soft[:, 0])
    raw = Model(buckets, float(bias[1] - bias[0]), 1.0, 0.0)
    slope, shift = _logistic(Scorer(raw, p).highest(texts), label)
    return Model(buckets, raw.bias, slope, shift)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """Newton steps for ``P(y) = 1 / (1 + exp(-(slope * x + shift)))`` with a small ridge."""
    a, ridge = np.stack([x, np.ones(len(x))], 1), np.diag([1e-2, 1e-4])
    w = np.zeros(2)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w - np.linalg.solve(a.T @ (a * (q * (1 - q) + 1e-6)[:, None]) + ridge, a.T @ (q - y) + ridge @ w)
    return float(w[0]), float(w[1])


class Scorer:
    """Scores texts; a word's value is computed once per task (the memo is
    emptied when it holds ``memo`` words)."""

    def __init__(self, model: Model, p: Params, memo: int = 1_000_000):
        self.model, self.p, self.memo, self.known = model, p, memo, {}

    def learn(self, tokens: list[str]) -> None:
        words = [clean(t) for t in tokens]
        at, ids = subwords(words, self.p)
        value = np.bincount(at, self.model.buckets[ids], len(words)) / np.maximum(np.bincount(at, minlength=len(words)), 1)
        self.known.update((t, x if w else np.nan) for t, w, x in zip(tokens, words, value.tolist(), strict=True))

    def highest(self, texts: list[str | None], step: int = 500) -> np.ndarray:
        """The highest passage of each text."""
        out = np.full(len(texts), self.model.bias)
        for start in range(0, len(texts), step):
            split = [t.split() if t else [] for t in texts[start:start + step]]
            if len(self.known) > self.memo:
                self.known.clear()
            new = set().union(*split).difference(self.known)
            if new:
                self.learn(list(new))
            for i, tokens in enumerate(split, start):
                values = np.fromiter(map(self.known.__getitem__, tokens), np.float64, len(tokens))
                values = values[~np.isnan(values)]
                values = values[once(values)]
                if len(values):
                    s = passages(len(values), self.p.span)
                    out[i] += (np.add.reduceat(values, s) / np.diff(np.append(s, len(values)))).max()
        return out

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.highest(texts) * self.model.slope + self.model.shift, -30, 30)))


def training_sample(docs: DataFrame, labels: DataFrame, p: Params, label: str = "toxic") -> tuple[list[str], list[int]]:
    """At most ``per_class`` texts of each label, chosen by a hash of the id,
    none of them held out.  Rows with a null id or label teach nothing."""
    known = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
                   .groupBy("doc_id").agg(F.max(label).alias("_label")))
    parts = [known.where(F.col("_label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.per_class) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1])                       # 2 * per_class rows at most
    rows = (docs.select("doc_id", "text").where(F.length("text") <= p.max_chars).join(F.broadcast(chosen), "doc_id")
                .orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(2 * p.per_class).collect())
    return [r["text"] or "" for r in rows], [int(r["_label"]) for r in rows]


def score(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` in place of any
    columns of these names."""
    model = docs.sparkSession.sparkContext.broadcast(fit(*training_sample(docs, labels, p), p))   # 8 bytes a bucket
    keep = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]

    def run(batches):
        import pyarrow as pa
        scorer = Scorer(model.value, p)
        for b in batches:
            value = scorer(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(value)], [*b.schema.names, "score"])

    base = docs.select(*keep)
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())])
    return (base.mapInArrow(run, schema)
                .withColumn("held_out", held_out(F.col("doc_id")))
                .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def toxicity(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The contract's rows: ``doc_id, held_out, score, predicted``."""
    return score(docs.select("doc_id", "text"), labels, p).select("doc_id", "held_out", "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The filtering stage: rows predicted 0, columns unchanged."""
    rows = boxed(docs, doc_id=F.col("doc_id"), text=F.col("text"))
    return unboxed(score(rows, labels, p).where("predicted = 0"), docs)
