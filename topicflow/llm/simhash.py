"""SimHash near-dedup by tiled exact comparison.

Fingerprints: the majority of the XXH64 bits of a text's word shingles.
Equal fingerprints are one vertex.  The vertices are cut into tiles of one
population count and at most about ``tile`` fingerprints; tiles whose
population counts differ by more than the radius cannot hold a pair within
it, so only the others meet.  Two tiles meet in one task, which compares them
exactly with numpy exclusive-or and bit counts; inside, rows are ordered by
the population counts of the four 16-bit parts, and blocks whose part counts
differ by more than the radius in all are skipped the same way.

A task returns a spanning forest of the links it finds, never all pairs of a
dense group, so its output is bounded by its input.  The forests' union has
the components of all links; they are found by large-star and small-star
rounds until nothing changes.

Defined results: null, empty and wordless texts have fingerprint zero and
link like any other; repeated rows stay; null ids never are the smallest
unless a component has no other; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, stored, unboxed


@dataclass(frozen=True)
class Params:
    shingle: int = 4
    radius: int = 4
    tile: int = 16384              # fingerprints in a tile, about
    block: int = 512               # rows compared at a time inside a task


LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    from xxhash import xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(size, len(words)) - 1:].tolist()
    return np.fromiter((xxh64_intdigest(line[i:j], 42) for i, j in zip(starts.tolist(), last)), np.uint64, len(last))


def fingerprint(hashes: np.ndarray, step: int = 4096) -> int:
    """Bit set where over half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), step):
        ones += np.unpackbits(hashes[i:i + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id, th, fp``: fingerprint as a signed long, ``th`` a hash of the text."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            fp = [fingerprint(shingle_hashes(t, p.shingle)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "th", "fp"])
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
                .mapInArrow(run, "doc_id long, th long, fp long"))


class Forest:
    """Union-find over the rows of one task."""

    def __init__(self, n: int):
        self.root, self.edges = np.arange(n), []

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links ``a[i] - b[i]``; links inside one tree are dropped in bulk."""
        while len(a):
            ra, rb = self._roots(a), self._roots(b)
            other = ra != rb
            if not other.any():
                return
            a, b, ra, rb = a[other], b[other], ra[other], rb[other]
            _, first = np.unique(np.minimum(ra, rb) * len(self.root) + np.maximum(ra, rb), return_index=True)
            for k in first.tolist():
                x, y = self.find(int(ra[k])), self.find(int(rb[k]))
                if x != y:
                    self.root[max(x, y)] = min(x, y)
                    self.edges.append((int(a[k]), int(b[k])))

    def _roots(self, i: np.ndarray) -> np.ndarray:
        r = self.root[i]
        while (up := self.root[r]).tolist() != r.tolist():
            r = up
        return r


def _ordered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by the population counts of the four parts, which come along."""
    parts = np.bitwise_count(x.view(np.uint16).reshape(-1, 4)).astype(np.int8)
    order = np.lexsort((parts[:, 3], parts[:, 2], parts[:, 1], parts[:, 0]))
    return x[order], parts[order]


def links(left: np.ndarray, right: np.ndarray | None, p: Params) -> list[tuple[int, int]]:
    """Spanning forest of the pairs within the radius, in one tile or between two."""
    a, pa = _ordered(left)
    b, pb = (a, pa) if right is None else _ordered(right)
    shift = 0 if right is None else len(a)
    forest = Forest(len(a) + (0 if right is None else len(b)))
    cut = range(0, len(b), p.block)
    low, high = (np.array([f(pb[j:j + p.block], axis=0) for j in cut]) for f in (np.min, np.max))
    for i in range(0, len(a), p.block):
        x, px = a[i:i + p.block], pa[i:i + p.block]
        gap = np.maximum(0, np.maximum(low - px.max(0), px.min(0) - high)).sum(1)
        for k in np.flatnonzero(gap <= p.radius):
            j = int(k) * p.block
            if right is None and j < i:
                continue
            y = b[j:j + p.block]
            r, c = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= p.radius)
            r, c = r + i, c + j + shift
            if right is None:
                r, c = r[r < c], c[r < c]
            forest.add(r, c)
    both = a if right is None else np.concatenate([a, b])
    return [(int(both[i]), int(both[j])) for i, j in forest.edges]


def tiles(fps: DataFrame, p: Params) -> tuple[DataFrame, dict[int, int]]:
    """``ones, part, fps``: packed tiles, and the number of parts of each
    population count (65 numbers at most, the only thing the driver sees)."""
    ones = fps.select("fp", F.bit_count("fp").alias("ones"))
    parts = {r["ones"]: -(-r["n"] // p.tile) for r in ones.groupBy("ones").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = F.create_map(*[F.lit(x) for kv in (parts or {0: 1}).items() for x in kv])

    def pack(key, pdf):
        import pandas as pd
        return pd.DataFrame({"ones": [int(key[0])], "part": [int(key[1])], "fps": [np.sort(pdf["fp"].to_numpy()).tobytes()]})

    dealt = ones.withColumn("part", F.pmod(F.xxhash64("fp"), sizes[F.col("ones")]).cast("int"))
    return dealt.groupBy("ones", "part").applyInPandas(pack, "ones int, part int, fps binary"), parts


def edges(fps: DataFrame, p: Params) -> DataFrame:
    """``a, b``: links that connect what all links within the radius connect."""
    packed, parts = tiles(fps, p)
    packed = stored(packed, "simhash-tiles")
    # Meetings: each unordered pair of tiles whose counts are near enough, once.
    count = F.create_map(*[F.lit(x) for kv in (parts or {0: 1}).items() for x in kv])
    mine = packed.withColumn("meet", F.explode(F.sequence(F.greatest(F.lit(0), F.col("ones") - p.radius), F.least(F.lit(64), F.col("ones") + p.radius))))
    mine = (mine.withColumn("k", F.try_element_at(count, F.col("meet"))).where("k is not null")
                .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))))
    me, you = F.struct("ones", "part"), F.struct(F.col("meet").alias("ones"), F.col("other").alias("part"))
    rows = mine.select(F.least(me, you).alias("x"), F.greatest(me, you).alias("y"), "fps")

    def compare(key, pdf):
        import pandas as pd
        x = [np.frombuffer(v, np.uint64) for v in pdf["fps"]]
        found = links(x[0], x[1] if len(x) > 1 else None, p)
        out = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})

    meetings = rows.groupBy(F.col("x.ones").alias("x1"), F.col("x.part").alias("x2"), F.col("y.ones").alias("y1"), F.col("y.part").alias("y2"))
    return meetings.applyInPandas(compare, "a long, b long")


def components(pairs: DataFrame, name: str = "components") -> DataFrame:
    """``v, root`` for every vertex in ``pairs (a, b)``: alternate large-star and
    small-star until the edges are stars around each component's least vertex.
    Minimums pre-aggregate and the joins split hot vertices."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u")
        if large:
            out = out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = (out.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
                      .unionByName(least.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b"))))
        return out.where("a <> b").distinct()

    e, before = stored(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name), None
    while True:
        e = stored(star(star(e, True), False), name)
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())


def groups(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id, th, fp, component_id`` for every row."""
    rows = stored(fingerprints(docs, p), "simhash-rows")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(edges(distinct.select("fp"), p), "simhash-edges")
    fp_root = distinct.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    fp_root = stored(fp_root, "simhash-roots")
    least = fp_root.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(fp_root.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "th", "fp", "component_id")


def simhash(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The contract's rows: ``doc_id, fingerprint, component_id``."""
    return groups(docs, p).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row of each group stays: that of the smallest id (of rows that share
    this id, the one with the least text hash; of equal rows, any one)."""
    g = groups(docs, p)
    chosen = (g.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
               .groupBy("component_id").agg(F.min("th").alias("least"))
               .select(F.col("component_id").alias("kept"), "least"))
    rows = boxed(docs, id=F.col("doc_id"), th=F.xxhash64("text"))
    near = rows.join(chosen, F.col("id").eqNullSafe(F.col("kept")) & (F.col("th") == F.col("least")), "leftsemi")
    return unboxed(near.dropDuplicates(["id", "th"]), docs)
