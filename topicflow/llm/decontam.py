"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores, shard by shard, the postings of every training token:
for each term the ascending positions where it stands.  A shard is a run of
whole documents of one input split, so building needs no shuffle, and shard
and postings are bounded by ``shard_words`` (one longer document is a shard
of its own).  Documents are laid out with a gap wider than any window, so no
match runs from one into the next.

``search`` finds each test window in each shard: its terms are ordered from
the rarest to the most frequent in the shard, the rarest term's positions,
shifted by its offset, are the candidates, and each further list, shifted by
its own offset, thins them.  Exact phrases need equal positions; proximity
matches allow each word to stray by ``slack`` positions.  Windows whose terms
the shard lacks cost one dictionary lookup.

The test set goes to the tasks in blocks of at most ``block_bytes`` of text,
one pass over the index for each block, and the blocks' results are merged
per document, so any size of test set takes the same path.

Words: A-Z lower-cased, then runs of characters other than ASCII
non-alphanumerics.  A window is ``width`` consecutive words of an item; a
shorter item, but not a wordless one, is one window.

Defined results: null texts have no words; null and empty items match
nothing; repeated items count as one item id; repeated documents keep their
multiplicity; other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, stored, unboxed


@dataclass(frozen=True)
class Params:
    width: int = 10
    slack: int = 0                 # 0: exact phrases only
    shard_words: int = 1_000_000
    block_bytes: int = 16 << 20    # test text broadcast at a time


# One byte for each byte: ASCII letters in lower case, digits and all non-ASCII bytes stay, the rest is a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


INDEX = "name binary, ids binary, nulls binary, th binary, starts binary, lens binary, terms binary, firsts binary, postings binary"


def _shard(ids: list, th: list, texts: list[list[bytes]], gap: int) -> dict:
    lens = np.array([len(w) for w in texts], np.int64)
    starts = np.cumsum(lens + gap) - lens - gap
    code: dict[bytes, int] = {}
    flat = np.fromiter((code.setdefault(w, len(code)) for t in texts for w in t), np.int32, int(lens.sum()))
    place = np.arange(len(flat)) + np.repeat(starts - np.cumsum(lens) + lens, lens)
    order = np.argsort(flat, kind="stable")
    firsts = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(code)))])
    return {"name": uuid.uuid4().bytes, "ids": np.array([i or 0 for i in ids], np.int64).tobytes(), "nulls": np.array([i is None for i in ids]).tobytes(),
            "th": np.array(th, np.int64).tobytes(), "starts": starts.astype(np.int64).tobytes(), "lens": lens.tobytes(),
            "terms": b" ".join(code), "firsts": firsts.astype(np.int64).tobytes(), "postings": place[order].astype(np.uint32).tobytes()}


def build_index(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row for each shard, written to the shared folder."""
    gap = p.width + 2 * p.slack + 1

    def run(batches):
        import pyarrow as pa
        names = [x.split()[0] for x in INDEX.split(", ")]
        ids, th, texts, size = [], [], [], 0

        def flush():
            row = _shard(ids, th, texts, gap)
            return pa.RecordBatch.from_pydict({k: pa.array([row[k]], pa.binary()) for k in names})

        for b in batches:
            for i, h, t in zip(*(c.to_pylist() for c in b.columns)):
                w = words(t)
                if texts and size + len(w) > p.shard_words:
                    yield flush()
                    ids, th, texts, size = [], [], [], 0
                ids.append(i)
                th.append(h)
                texts.append(w)
                size += len(w) + gap
        if texts:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return stored(rows.mapInArrow(run, INDEX), "positional-index")


class Shard:
    """One stored shard, ready for look-ups."""

    def __init__(self, row: dict):
        self.ids, self.th = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["th"], np.int64)
        self.nulls = np.frombuffer(row["nulls"], np.bool_)
        self.starts, self.lens = np.frombuffer(row["starts"], np.int64), np.frombuffer(row["lens"], np.int64)
        self.code = {w: i for i, w in enumerate(row["terms"].split())}
        self.firsts, self.postings = np.frombuffer(row["firsts"], np.int64), np.frombuffer(row["postings"], np.uint32)

    def list(self, term: bytes) -> np.ndarray | None:
        i = self.code.get(term)
        return None if i is None else self.postings[self.firsts[i]:self.firsts[i + 1]]

    def find(self, window: tuple[bytes, ...], slack: int) -> np.ndarray:
        """First positions of the window, intersecting from its rarest term."""
        lists = []
        for k, w in enumerate(window):
            at = self.list(w)
            if at is None:
                return np.zeros(0, np.int64)
            lists.append((len(at), k, at))
        lists.sort(key=lambda x: x[:2])
        _, k, at = lists[0]
        starts = at.astype(np.int64) - k
        if slack:                                      # the rarest term may stray too
            starts = np.unique(starts[:, None] + np.arange(-slack, slack + 1))
        for _, k, at in lists[1:]:
            if not len(starts):
                break
            spot = np.searchsorted(at, np.maximum(starts + k - slack, 0))
            starts = starts[(spot < len(at)) & (at[np.minimum(spot, len(at) - 1)] <= starts + k + slack) & (starts + k + slack >= 0)]
        return starts


def windows(text: str | None, width: int) -> list[tuple[bytes, ...]]:
    w = words(text)
    return [tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))] if w else []


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.concatenate([new[1:], [True]])]


HITS = "shard binary, ordinal int, doc_id long, th long, n_words long, items array<string>, spans array<struct<s:long,e:long>>"


def _search_block(index: DataFrame, items: list[tuple], p: Params) -> DataFrame:
    """One row for each document: the items found in it and the spans they hit."""
    where: dict[tuple, list[str]] = {}
    for item, text in items:
        for w in windows(text, p.width):
            where.setdefault(w, []).extend([] if item is None else [str(item)])      # an item without an id hits, but is not named
    found = index.sparkSession.sparkContext.broadcast([(w, sorted(set(i))) for w, i in where.items()])

    def run(batches):
        import pyarrow as pa
        span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        for b in batches:
            for row in b.to_pylist():
                s = Shard(row)
                n = len(s.ids)
                at, size, who = [], [], []
                for window, owners in found.value:
                    starts = s.find(window, p.slack)
                    if len(starts):
                        at.append(starts)
                        size.append(np.full(len(starts), len(window)))
                        who += [owners] * len(starts)
                items, spans = [[] for _ in range(n)], [[] for _ in range(n)]
                if at:
                    at, size = np.concatenate(at), np.concatenate(size)
                    doc = np.searchsorted(s.starts, at + p.slack, "right") - 1
                    begin = np.maximum(at - p.slack - s.starts[doc], 0)
                    end = np.minimum(at + size + p.slack - s.starts[doc], s.lens[doc])
                    by = np.argsort(doc, kind="stable")
                    cut = np.searchsorted(doc[by], np.arange(n + 1))
                    for d in np.unique(doc).tolist():
                        mine = by[cut[d]:cut[d + 1]]
                        spans[d] = [{"s": int(x), "e": int(y)} for x, y in zip(*_merged(begin[mine], end[mine]))]
                        items[d] = sorted({i for k in mine.tolist() for i in who[k]})
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["name"]] * n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array(s.ids, mask=s.nulls),
                    pa.array(s.th), pa.array(s.lens), pa.array(items, pa.list_(pa.string())), pa.array(spans, span)],
                    ["shard", "ordinal", "doc_id", "th", "n_words", "items", "spans"])

    return index.mapInArrow(run, HITS)


def search(index: DataFrame, items: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id, th, n_words, items, spans`` for every indexed document; spans
    are disjoint, ascending and half open, in words."""
    items = items.select(F.col("item_id"), "text").where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // p.block_bytes))
    parts = []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()     # about block_bytes
        part = _search_block(index, [tuple(r) for r in rows], p)
        parts.append(part if blocks == 1 else stored(part, "decontam-hits"))      # one block's windows are held at a time
    if blocks == 1:
        return parts[0].drop("shard", "ordinal")
    both = parts[0]
    for x in parts[1:]:
        both = both.unionByName(x)
    spans = F.sort_array(F.flatten(F.collect_list("spans")))
    disjoint = F.aggregate(spans, F.array().cast("array<struct<s:bigint,e:bigint>>"), lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["s"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e"))))
    ).otherwise(F.concat(acc, F.array(x))))
    return (both.groupBy("shard", "ordinal", "doc_id", "th", "n_words")
                .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), disjoint.alias("spans"))
                .drop("shard", "ordinal"))


def decontaminate(docs: DataFrame, items: DataFrame, p: Params = Params()) -> DataFrame:
    """The contract's rows: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    hits = search(build_index(docs, p), items, p)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, p: Params = Params()) -> DataFrame:
    """The filtering stage: documents without any hit, columns unchanged."""
    bad = (search(build_index(docs, p), items, p).where(F.size("spans") > 0)
           .select(F.col("doc_id").alias("bad"), F.col("th").alias("hash")).distinct())
    rows = boxed(docs, id=F.col("doc_id"), th=F.xxhash64("text"))
    return unboxed(rows.join(bad, F.col("id").eqNullSafe(F.col("bad")) & (F.col("th") == F.col("hash")), "leftanti"), docs)
