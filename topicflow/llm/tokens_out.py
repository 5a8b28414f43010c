"""Token ids in patched frame-of-reference blocks.

Ids are written in ascending document order.  A shard holds whole documents;
its ids are cut into blocks of ``block`` ids, and a block stores its minimum,
the differences from it packed at the width that fits the ``percentile`` of
them, and an exception list (position, difference) for the others.  An index
of block starts lets a reader open any block alone.

    magic "PFB1" | block u32 | ids u64 | blocks u32 | documents u32
    document ids i64[] | null marks u8[] | lengths u64[]
    block starts u64[], from the first block on
    blocks: minimum u32 | width u8 | exceptions u16 |
            bit planes, lowest first, block / 8 bytes each |
            exception positions u16[] | exception differences u32[]

All numbers are little-endian.  A shard is a value of a Parquet file's binary
column: Spark's commit protocol then covers lost executors and repeated
tasks, on any file system.  ``part`` (the range of ids) and ``seq`` order the
shards.  The documents are range-partitioned by id once; nothing else moves
their text.

Defined results: null text is empty and gets only the end id; null ids come
first; rows of one id are ordered by text; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import blocks as row_blocks
from .common import scratch

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")     # letters that are one character in every normal form used, and fold one by one
#: Steps of a tokenizer that folds letters and keeps punctuation behind them apart.
STEPS = (("NFC", "Replace", "Lowercase"), ("Split", "ByteLevel"), ("BPE",))
MAGIC, HEAD, BLOCK = b"PFB1", struct.Struct("<4sIQII"), struct.Struct("<IBH")


@dataclass(frozen=True)
class Params:
    tokenizer: str = "word_bpe_49k.json"           # a file of public_tokenizers, or a path
    end: int | None = 2                            # appended to each document
    block: int = 1024                              # ids in a block, a multiple of 8
    percentile: float = 0.95
    shard_ids: int = 1 << 20                       # a shard ends with the document that reaches it
    memo: int = 600_000


# -- blocks ---------------------------------------------------------------------

def pack(ids: np.ndarray, p: Params = Params()) -> list[bytes]:
    """The blocks of an id sequence."""
    n = -(-len(ids) // p.block)
    if not n:
        return []
    table = np.empty(n * p.block, np.uint32)
    table[:len(ids)], table[len(ids):] = ids, ids[-1]
    table = table.reshape(n, p.block)
    low = table.min(1)
    table = table - low[:, None]
    middle = np.partition(table, k := int(p.percentile * (p.block - 1)), axis=1)[:, k]
    width = np.ceil(np.log2(middle.astype(np.float64) + 1)).astype(np.int64)
    over = (table >> width[:, None].astype(np.uint32)) > 0
    over[width >= 32] = False
    out: list[bytes] = [b""] * n
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w)
        x = table[mine]
        small = x.astype(np.uint16) if w <= 16 else x
        planes = [np.packbits(((small >> b) & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(w)]
        body = np.concatenate(planes, 1) if planes else np.zeros((len(mine), 0), np.uint8)
        for i, k in enumerate(mine.tolist()):
            at = np.flatnonzero(over[k])
            out[k] = b"".join((BLOCK.pack(low[k], w, len(at)), body[i].tobytes(), at.astype("<u2").tobytes(), x[i, at].astype("<u4").tobytes()))
    return out


def unpack(blocks: list[bytes | memoryview], p: Params = Params()) -> np.ndarray:
    """The ids of full blocks (the last one's padding included)."""
    out = np.zeros((len(blocks), p.block), np.uint32)
    heads = [BLOCK.unpack_from(b) for b in blocks]
    width = np.array([h[1] for h in heads], np.int64)
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w)
        size = w * p.block // 8
        body = np.frombuffer(b"".join([blocks[k][BLOCK.size:BLOCK.size + size] for k in mine.tolist()]), np.uint8).reshape(len(mine), w, p.block // 8)
        x = np.zeros((len(mine), p.block), np.uint16 if w <= 16 else np.uint32)
        for b in range(w):
            x |= np.unpackbits(body[:, b], axis=1, bitorder="little").astype(x.dtype) << b
        out[mine] = x
    for k, (low, w, n) in enumerate(heads):
        if n:
            first = BLOCK.size + w * p.block // 8
            out[k, np.frombuffer(blocks[k], "<u2", n, first)] = np.frombuffer(blocks[k], "<u4", n, first + 2 * n)
    out += np.array([h[0] for h in heads], np.uint32)[:, None] if heads else 0
    return out.reshape(-1)


# -- shards -----------------------------------------------------------------------

def shard(doc_ids: list[int | None], ids: list[np.ndarray], p: Params = Params()) -> bytes:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    body = pack(flat, p)
    starts = np.cumsum([0, *map(len, body)])[:-1]
    return b"".join((HEAD.pack(MAGIC, p.block, len(flat), len(body), len(doc_ids)),
                     np.array([i or 0 for i in doc_ids], "<i8").tobytes(), np.array([i is None for i in doc_ids], np.uint8).tobytes(),
                     np.array([len(x) for x in ids], "<u8").tobytes(), starts.astype("<u8").tobytes(), *body))


class Reader:
    """A shard's documents and, through the index, any of its blocks."""

    def __init__(self, data: bytes):
        magic, block, self.n_ids, n_blocks, n_docs = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.p, at = Params(block=block), HEAD.size
        self.doc_ids, at = np.frombuffer(data, "<i8", n_docs, at), at + 8 * n_docs
        self.nulls, at = np.frombuffer(data, np.uint8, n_docs, at).astype(bool), at + n_docs
        self.lens, at = np.frombuffer(data, "<u8", n_docs, at).astype(np.int64), at + 8 * n_docs
        self.starts, self.body = np.frombuffer(data, "<u8", n_blocks, at).astype(np.int64), memoryview(data)[at + 8 * n_blocks:]

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of the blocks from ``first`` up to ``last``."""
        ends = np.append(self.starts, len(self.body))
        ids = unpack([self.body[ends[k]:ends[k + 1]] for k in range(first, last)], self.p)
        return ids[:max(0, self.n_ids - first * self.p.block)]

    def ids(self) -> np.ndarray:
        return self.blocks(0, len(self.starts))


# -- tokenizer ----------------------------------------------------------------------

class Memo(dict):
    """Ids of each piece met, in two generations: when the young one is full
    the old one goes, and what is met again moves from old to young."""

    def __init__(self, encode, size: int):
        super().__init__()
        self.encode, self.size, self.old = encode, size, {}

    def turn(self) -> None:
        if len(self) > self.size // 2:
            self.old = dict(self)
            self.clear()

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
        self[piece] = ids
        return ids


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    bytes for themselves, the others by the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(plain)))}


class Encoder:
    """The tokenizer drops white space and never joins across it, so pieces
    between spaces and newlines are encoded once and looked up.  ASCII
    punctuation behind letters is a token run of its own, so a new piece is
    looked up without it, and a new word of Latin letters, which are folded,
    goes to the merges at once.  (Only for a tokenizer whose steps are STEPS;
    any other gets whole pieces.)"""

    def __init__(self, p: Params):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"             # a task has one core
        from tokenizers import Tokenizer
        name = p.tokenizer
        if "/" not in name:
            import public_tokenizers
            name = public_tokenizers.path(name)
        self.p, self.tokenizer = p, Tokenizer.from_file(name)
        self.end = b"" if p.end is None else struct.pack("<I", p.end)
        spec = json.loads(self.tokenizer.to_str())
        parts = ((spec["normalizer"] or {}).get("normalizers", []), (spec["pre_tokenizer"] or {}).get("pretokenizers", []), [spec["model"]])
        self.folds = tuple(tuple(x["type"] for x in part) for part in parts) == STEPS and not spec["model"].get("dropout")
        self.model, self.letter = self.tokenizer.model, byte_letters()
        self.known = Memo(self.piece if self.folds else self.whole, p.memo)

    def whole(self, piece: str) -> bytes:
        ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def piece(self, piece: str) -> bytes:
        core = piece.rstrip(PUNCTUATION)
        if not core.isalpha():
            return self.whole(piece)
        if len(core) < len(piece):
            return self.known[core] + self.known[piece[len(core):]]
        if not LATIN.fullmatch(core):
            return self.whole(core)
        low = core.lower()
        if low != core:
            return self.known[low]
        if not low.isascii():
            low = low.encode().decode("latin-1").translate(self.letter)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(low)])

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        self.known.turn()
        get = self.known.__getitem__
        return [np.frombuffer(b"".join([*map(get, (t or "").replace("\n", " ").split(" ")), self.end]), "<u4") for t in texts]


@lru_cache(maxsize=1)
def encoder(p: Params) -> Encoder:
    return Encoder(p)


# -- Spark ----------------------------------------------------------------------------

def write(docs: DataFrame, path: str, p: Params = Params()) -> None:
    """Shards of all documents in ascending id order below ``path``."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part, seq = TaskContext.get().partitionId(), 0
        encode, doc_ids, ids, size = encoder(p), [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([size], pa.int64()),
                                               pa.array([shard(doc_ids, ids, p)], pa.binary())], ["part", "seq", "n_ids", "shard"])

        for rows in row_blocks(batches, 1, 4_000_000):
            for row, x in zip(rows, encode([r[1] for r in rows])):
                doc_ids.append(row[0])
                ids.append(x)
                size += len(x)
                if size >= p.shard_ids:
                    yield flush()
                    seq, doc_ids, ids, size = seq + 1, [], [], 0
        if doc_ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    (rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
         .mapInArrow(run, "part int, seq int, n_ids long, shard binary").write.parquet(path))


def read(spark: SparkSession, path: str, **value) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the files; ``start``
    counts the ids of all documents before it, ``ids`` are little-endian unsigned
    32-bit integers.  ``value`` names expressions over ``ids`` to return in its
    place; they are evaluated where the files are read."""
    value = value or {"ids": F.col("ids")}
    def run(batches):
        import pyarrow as pa
        for b in batches:
            for row in b.to_pylist():
                r = Reader(row["shard"])
                ids = r.ids().astype("<u4")
                ends = np.cumsum(r.lens)
                n = len(ends)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(r.doc_ids, mask=r.nulls),
                    pa.array(ends - r.lens), pa.array(r.lens), pa.array([ids[e - k:e].tobytes() for e, k in zip(ends, r.lens)], pa.binary())],
                    ["part", "seq", "doc_id", "local", "n_tokens", "ids"])

    files = spark.read.schema("part int, seq int, n_ids long, shard binary").parquet(path)
    # Ids before each shard: before its part (one row a part), and before it inside the part.
    sizes = files.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    offset = (sizes.withColumn("inner", F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids"))
                   .join(parts, "part").select("part", "seq", (F.col("before") + F.col("inner")).alias("offset")))
    docs = files.select("part", "seq", "shard").mapInArrow(run, "part int, seq int, doc_id long, local long, n_tokens long, ids binary")
    docs = docs.select("part", "seq", "doc_id", "local", "n_tokens", *[v.alias(k) for k, v in value.items()])
    return docs.join(offset, ["part", "seq"]).select("doc_id", (F.col("offset") + F.col("local")).alias("start"), "n_tokens", *value)


def token_files(docs: DataFrame, p: Params = Params(), path: str | None = None) -> DataFrame:
    """Write, read back, and return the contract's rows: ``doc_id, start,
    n_tokens, ids_crc32``."""
    path = path or scratch(docs.sparkSession, "token-files")
    write(docs, path, p)
    return read(docs.sparkSession, path, ids_crc32=F.crc32("ids"))
