"""Periodic runs of words by online dyadic square catching.

Words are appended to a stream.  Every aligned block of a power of two of
words becomes a catcher as soon as it is complete.  Each appended word
completes one suffix of each block size, and that suffix is compared with the
catchers whose distance fits the size: a block of ``b`` words waits for its
copy at a distance from ``b`` up to ``2 b``.  A run of three or more periods
of that length holds a whole aligned block and its copy, so each run meets a
catcher at the level of its period; the smallest level also takes all shorter
distances, because a run has ``min_length`` words at least.

A hit is a square, or the middle of one.  It grows to both sides by suffix
comparisons of dyadic lengths, and squares of one stretch merge into a run.  A
stretch that touches the end of the stream stays open and is taken up again
by the next words.  Suffixes are compared by sums of hashed words (equal
words never differ in them), and a run is reported only after its words are
compared themselves, so results are exact.  An appended word costs a few
array operations for each level, and memory grows with the stream alone.

A task feeds whole documents to one stream, with a unique mark between them,
``step`` words at a time, and starts a new stream after ``block_chars``
characters: nothing is shuffled, and a document is one unit of work.

Defined results: null and empty texts have no words, no runs and an empty
collapsed text; rows equal in id are independent; null ids are kept; other
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import blocks as row_blocks
from .common import let

WORD = r"[^\x20\x09-\x0D]+"
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)            # odd, so that it has an inverse


@dataclass(frozen=True)
class Params:
    min_length: int = 24
    repeats: int = 3                 # periods a run holds at least, 2 or more
    step: int = 1 << 16              # words appended at once
    block_chars: int = 4_000_000     # characters of a stream, but for the last document


class Powers:
    """Powers of ``BASE`` and of its inverse modulo 2^64, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            inverse = np.uint64(pow(int(BASE), -1, 2 ** 64))
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)))) for x in (BASE, inverse))


POWERS = Powers()


def mix(ids: np.ndarray) -> np.ndarray:
    """A 64-bit value for each word number."""
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Stream:
    """Append word numbers; ``runs()`` after ``close()`` gives the runs as rows
    ``start, end, period``.  No run is longer than ``longest`` words."""

    def __init__(self, p: Params = Params(), longest: int | None = None):
        if p.repeats < 2:
            raise ValueError("a run repeats its period at least once")
        self.p, self.longest = p, longest
        self.least = max(p.min_length, p.repeats)
        self.near = 1 if p.repeats >= 3 else 2          # a catcher of b words begins at the distance near * b
        self.first = 1
        while (2 + self.near) * 2 * self.first - 2 <= self.least:
            self.first *= 2
        self.n, self.word, self.sum = 0, np.zeros(1, np.int64), np.zeros(2, np.uint64)
        self.open = np.zeros((0, 2), np.int64)           # start, period of stretches up to the end
        self.found: dict[tuple[int, int], int] = {}      # (start, end) -> smallest period
        self.starts = np.zeros((0, 3), np.int64)         # the same by start, to pass over what is known

    # -- comparisons -------------------------------------------------------------

    def _equal(self, a: np.ndarray, q: np.ndarray, size) -> np.ndarray:
        """Are the ``size`` words from ``a`` those from ``a + q``?"""
        left = (self.sum[a + size] - self.sum[a]) * POWERS.up[q]
        return left == self.sum[a + q + size] - self.sum[a + q]

    def _grow(self, at: np.ndarray, q: np.ndarray, room: np.ndarray, forward: bool) -> np.ndarray:
        """How far equality at distance ``q`` holds from ``at`` on, or before it."""
        grown = np.zeros(len(at), np.int64)
        size = 1 << int(room.max(initial=0)).bit_length()
        while size:
            fits = np.flatnonzero(grown + size <= room)
            a = at[fits] + grown[fits] if forward else at[fits] - grown[fits] - size
            fits = fits[self._equal(a, q[fits], size)]
            grown[fits] += size
            size >>= 1
        return grown

    # -- the stream ----------------------------------------------------------------

    def append(self, words: np.ndarray) -> None:
        old, new = self.n, self.n + len(words)
        if not len(words):
            return
        POWERS.reach(new + 1)
        if new > len(self.word):
            size = max(new, 2 * len(self.word))
            self.word, self.sum = np.resize(self.word, size), np.resize(self.sum, size + 1)
        self.word[old:new] = words
        np.cumsum(mix(words) * POWERS.up[old:new], out=self.sum[old + 1:new + 1])
        self.sum[old + 1:new + 1] += self.sum[old]
        self.n = new
        if len(self.open):
            s, q = self.open.T
            grown = self._grow(np.full(len(s), old) - q, q, np.full(len(s), new - old), True)
            self._settle(s, old + grown, q)
        size, most = self.first, (self.longest or new) // self.p.repeats
        while size == self.first or self.near * size <= most:
            self._catch(size, old)
            size *= 2

    def _catch(self, size: int, old: int) -> None:
        """Compare each suffix of ``size`` words that is new with its catchers."""
        a, z = max(0, old - size + 1), self.n - size + 1
        if z <= a:
            return
        start = np.arange(a, z)
        suffix = (self.sum[a + size:z + size] - self.sum[a:z]) * POWERS.down[a:z]
        block = start // size
        lead = np.arange(max(0, block[0] - 2 * self.near), block[-1] + 1) * size
        lead = lead[lead + size <= self.n]
        catcher = (self.sum[lead + size] - self.sum[lead]) * POWERS.down[lead]
        at, far = [], []
        for j in range(0 if size == self.first else self.near, 2 * self.near):
            k = block - j - lead[0] // size
            have = int(np.searchsorted(k, 0))
            if j == 0:
                have_to = int(np.searchsorted(k, len(lead)))
            else:
                have_to = len(k)
            hit = have + np.flatnonzero(suffix[have:have_to] == catcher[k[have:have_to]])
            i = lead[k[hit]]
            q = start[hit] - i
            at.append(i[q > 0])
            far.append(q[q > 0])
        i, q = np.concatenate(at), np.concatenate(far)
        if len(i):
            self._hits(i, q, size)

    def _hits(self, i: np.ndarray, q: np.ndarray, size: int) -> None:
        known = self.starts
        if len(self.open):
            known = np.concatenate((known, np.insert(self.open, 1, self.n, axis=1)))
            known = known[np.lexsort((-known[:, 2], known[:, 0]))]
        if len(known):                                   # a multiple of a known run's period, inside that run
            k = np.searchsorted(known[:, 0], i, "right") - 1
            s, e, own = known[np.maximum(k, 0)].T
            new = ~((k >= 0) & (i + size + q <= e) & (q % own == 0))
            i, q = i[new], q[new]
            if not len(i):
                return
        right = self._grow(i + size, q, self.n - i - size - q, True)
        left = self._grow(i, q, i, False)
        self._settle(np.concatenate((self.open[:, 0], i - left)), np.concatenate((np.full(len(self.open), self.n), i + size + q + right)),
                     np.concatenate((self.open[:, 1], q)))

    def _settle(self, s: np.ndarray, e: np.ndarray, q: np.ndarray) -> None:
        """Merge stretches: open ones wait, ended ones of enough periods are runs."""
        ends = e < self.n
        self.open = self._merge(s[~ends], e[~ends], q[~ends])[:, [0, 2]]
        long = ends & (e - s >= np.maximum(self.least, self.p.repeats * q))
        self._report(s[long], e[long], q[long])

    @staticmethod
    def _merge(s: np.ndarray, e: np.ndarray, q: np.ndarray) -> np.ndarray:
        rows = np.unique(np.stack((s, e, q), 1), axis=0)
        if len(rows) < 2:
            return rows
        lead = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)]
        own = rows[np.maximum.accumulate(np.where(lead, np.arange(len(rows)), 0)), 2]
        whole = (rows[:, 2] % own == 0) & (rows[:, 1] - rows[:, 0] >= own + rows[:, 2])
        return rows[lead | ~whole]                       # multiples of the smallest period say nothing more

    def _report(self, s: np.ndarray, e: np.ndarray, q: np.ndarray) -> None:
        rows = self._merge(s, e, q)
        if not len(rows):
            return
        for a, z, r in rows.tolist():
            if self.found.get((a, z), r + 1) > r:
                for x, y in self._exact(a, z, r):
                    self.found[x, y] = min(r, self.found.get((x, y), r))
        known = np.array([(a, z, r) for (a, z), r in self.found.items()], np.int64).reshape(-1, 3)
        self.starts = known[np.argsort(known[:, 0], kind="stable")]

    def _exact(self, a: int, z: int, q: int) -> list[tuple[int, int]]:
        """The stretch by its words; its parts, should hashes have met by chance."""
        same = self.word[a:z - q] == self.word[a + q:z]
        if same.all():
            return [(a, z)]
        edge = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))
        return [(a + x, a + y + q) for x, y in edge.reshape(-1, 2).tolist() if y - x + q >= max(self.least, self.p.repeats * q)]

    def close(self) -> None:
        s, q = self.open.T
        e = np.full(len(s), self.n)
        long = e - s >= np.maximum(self.least, self.p.repeats * q)
        self._report(s[long], e[long], q[long])
        self.open = self.open[:0]

    def runs(self) -> np.ndarray:
        return self.starts[np.lexsort((self.starts[:, 2], self.starts[:, 0]))] if len(self.starts) else self.starts


def catch(documents: list[list], p: Params = Params()) -> list[list[tuple[int, int, int]]]:
    """``start, length, period`` of each document's runs, by start, then period."""
    number: dict = defaultdict()
    number.default_factory = number.__len__
    sizes = [len(d) for d in documents]
    stream, first, at = Stream(p, max(sizes, default=0)), [], 0
    flat = np.empty(sum(sizes) + len(sizes), np.int64)
    for k, d in enumerate(documents):
        first.append(at)
        flat[at:at + len(d)] = np.fromiter(map(number.__getitem__, d), np.int64, len(d))
        at += len(d) + 1
        flat[at - 1] = -1 - k                            # no other word equals it
    for i in range(0, len(flat), p.step):
        stream.append(flat[i:i + p.step])
    stream.close()
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    rows = stream.runs()
    for k, (s, e, q) in zip((np.searchsorted(first, rows[:, 0], "right") - 1).tolist(), rows.tolist()):
        out[k].append((s - first[k], e - s, q))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without what any run repeats after its first period."""
    if runs:
        step = np.zeros(len(words) + 1, np.int32)
        for s, n, q in runs:
            step[s + q] += 1
            step[s + n] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id, runs, collapsed``: every run of each document as ``start,
    length, period`` in words, by start, then period, and the text without the
    repetitions."""
    def run(batches):
        import pyarrow as pa
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for rows in row_blocks(batches, 1, p.block_chars):
            words = [(r[1] or b"").split() for r in rows]                   # white space of bytes is that of the pattern
            found = catch(words, p)
            texts = [collapse(w, f).decode() for w, f in zip(words, found)]
            for k in range(0, len(rows), 500):
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[k:k + 500]], pa.int64()), pa.array(found[k:k + 500], kind),
                                                  pa.array(texts[k:k + 500], pa.string())], ["doc_id", "runs", "collapsed"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
                .mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"))


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of the contract: a tenth of the documents, chosen by id,
    repeat a part of themselves from a word on that the id chooses."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(w: Column) -> Column:
        n = F.size(w).cast("long")
        return let(F.struct((g % n).alias("a"), (1 + F.floor((n - g % n) / (3 + g % 8))).alias("p")), lambda x: F.array_join(F.transform(
            w, lambda v, i: F.when(i < x["a"], v).otherwise(F.get(w, (x["a"] + (i - x["a"]) % x["p"]).cast("int")))), " "))

    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    text = F.when(h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, repeat(w)).otherwise(F.lit("")))).otherwise(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The contract's row of each document: counts, the run of greatest exact
    exponent (ties: smallest start, then period) and digests."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", none, lambda m, x: F.when(
        m.isNull() | (x["length"] * m["period"] > m["length"] * x["period"]), x).otherwise(m))
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    rows = found.withColumn("b", best)
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "b.start", "b.length", "b.period",
                       F.expr("(1000 * b.length) div b.period").alias("exponent_milli"),
                       F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
                       F.sha2("collapsed", 256).alias("collapsed_sha256"))
