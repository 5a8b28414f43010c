"""Byte-level BPE encoding and decoding by merge replay.

Encoding replays the merges on all distinct words of a block of the corpus at
once: the words' bytes lie in one array, an inverted index holds for each
token pair the positions where it stands, and the merges are applied in rank
order.  A merge looks up its positions, joins the pairs there, and puts only
the pairs with the touched neighbours into the index anew.  Nothing else is
visited, so the work is the number of merges made.

Blocks are runs of whole documents inside a task (``block_chars``; one longer
text is a block of its own), so encoding shuffles nothing, its memory is
bounded, and a lost executor costs its own blocks.  A word met in an earlier
block of the task keeps its ids until ``memo`` words are held.

A text is cut before each single space between two other characters; every
match of the pattern ends there too, so the pieces are cut by the pattern
piecewise and looked up as wholes.  Texts with other white space next to a
space take the pattern as a whole.

Defined results: null is the empty text; a lone surrogate cannot occur in a
Spark string; repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The Unicode White_Space characters, as the pattern's \\s.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NONE = np.iinfo(np.int32).max


@dataclass(frozen=True)
class Params:
    ranks: str = "byte_bpe_multi_50k.tiktoken"     # a file of public_tokenizers, or a path
    block_chars: int = 8_000_000
    memo: int = 500_000


def rank_file(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def load(name: str) -> "Vocabulary":
    with open(rank_file(name), "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, r in ranks.items():
            self.tokens[r] = token
        pairs = {}
        for token, r in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = r
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, NONE where it makes none."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], NONE).astype(np.int32)

    def one(self, word: bytes) -> list[int]:
        """The merges of a single word, one by one: the least rank first, the
        leftmost of equals."""
        ids = [self.ranks[word[i:i + 1]] for i in range(len(word))]
        while len(ids) > 1:
            r = self.rank(np.array(ids[:-1]), np.array(ids[1:]))
            k = int(np.argmin(r))
            if r[k] == NONE:
                break
            ids[k:k + 2] = [int(r[k])]
        return ids


class PairIndex:
    """Token pair -> positions over all words of a block, kept by the rank of
    the token the pair makes."""

    def __init__(self, vocabulary: Vocabulary, words: list[bytes]):
        self.v, self.words = vocabulary, words
        lens = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(lens)
        n = int(self.ends[-1]) if len(words) else 0
        self.token = vocabulary.byte[np.frombuffer(b"".join(words), np.uint8)]
        self.next = np.arange(1, n + 1, dtype=np.int32)
        self.prev = np.arange(-1, n - 1, dtype=np.int32)
        self.next[self.ends - 1] = -1
        self.prev[(self.ends - lens)[lens > 0]] = -1
        self.made = np.full(n, NONE, np.int32)           # rank of the pair that starts here
        inner = np.flatnonzero(self.next >= 0)
        self.made[inner] = vocabulary.rank(self.token[inner], self.token[inner + 1])
        self.alive = np.ones(n, bool)
        self.places: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []
        self.odd: set[int] = set()                       # words whose merges do not go up in rank
        self.put(inner, self.made[inner])

    def put(self, at: np.ndarray, made: np.ndarray) -> None:
        at, made = at[made != NONE], made[made != NONE]
        if not len(at):
            return
        order = np.argsort(made, kind="stable")
        at, made = at[order], made[order]
        cut = np.flatnonzero(made[1:] != made[:-1]) + 1
        for r, part in zip(made[np.concatenate([[0], cut])].tolist(), np.split(at, cut)):
            if r not in self.places:
                self.places[r] = []
                heapq.heappush(self.heap, r)
            self.places[r].append(part)

    def replay(self) -> None:
        done = -1
        while self.heap:
            r = heapq.heappop(self.heap)
            parts = self.places.pop(r)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[self.made[at] == r]
            if not len(at):
                continue
            if r < done:                                 # exact, one by one, below
                self.odd.update(np.searchsorted(self.ends, at, "right").tolist())
                self.made[at] = NONE
                continue
            done = r
            after = self.next[at]
            chained = np.concatenate([[False], after[:-1] == at[1:]])
            if chained.any():                            # x x x: take the first of each two, from the left
                head = np.maximum.accumulate(np.where(chained, -1, np.arange(len(at))))
                at = at[(np.arange(len(at)) - head) % 2 == 0]
                after = self.next[at]
            beyond = self.next[after]
            self.token[at] = r
            self.next[at] = beyond
            self.prev[beyond[beyond >= 0]] = at[beyond >= 0]
            self.alive[after] = False
            self.made[after] = NONE
            left = self.prev[at]
            touched = np.unique(np.concatenate([at, left[left >= 0]]))
            right = self.next[touched]
            made = np.where(right >= 0, self.v.rank(self.token[touched], self.token[np.maximum(right, 0)]), NONE).astype(np.int32)
            self.made[touched] = made
            self.put(touched, made)

    def encoded(self) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        self.replay()
        ids = self.token[self.alive].astype("<u4").tobytes()
        cut = np.concatenate([[0], np.cumsum(self.alive)])[self.ends] * 4 if len(self.ends) else self.ends
        out = [ids[i:j] for i, j in zip([0, *cut[:-1].tolist()], cut.tolist())]
        for k in self.odd:
            out[k] = np.array(self.v.one(self.words[k]), "<u4").tobytes()
        for k, w in enumerate(self.words):               # a word that is a token is that token
            if (r := self.v.ranks.get(w)) is not None:
                out[k] = r.to_bytes(4, "little")
        return out


@lru_cache(maxsize=1)
def patterns():
    import re

    import public_tokenizers
    import regex
    whole = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]").replace(r"\S", rf"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
    return whole, re.compile(r"\s |  | \s|^ | $")


class Encoder:
    """Encodes and decodes blocks of texts."""

    def __init__(self, p: Params = Params()):
        self.p, self.v = p, load(p.ranks)
        self.whole, self.loose = patterns()
        self.known: dict[str, bytes] = {}                # piece -> ids
        self.words: dict[bytes, bytes] = {}              # word -> ids

    def pieces(self, text: str) -> list[str]:
        if self.loose.search(text):
            return self.whole.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.pieces(t) if t else [] for t in texts]
        if len(self.known) > self.p.memo:
            self.known.clear()
            self.words.clear()
        new = list(set().union(*cut).difference(self.known))
        parts = [[w.encode() for w in self.whole.findall(x)] for x in new]
        fresh = list(set().union(*parts).difference(self.words))
        if fresh:
            self.words.update(zip(fresh, PairIndex(self.v, fresh).encoded()))
        self.known.update((x, b"".join([self.words[w] for w in ws])) for x, ws in zip(new, parts))
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.v.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=1)
def encoder(p: Params) -> Encoder:
    """One encoder for each Python worker, so its memo serves later tasks too."""
    return Encoder(p)


def blocks(batches, column: int, limit: int):
    """Rows of Arrow batches regrouped to at most ``limit`` characters."""
    held, size = [], 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            n = len(row[column] or "")
            if held and size + n > limit:
                yield held
                held, size = [], 0
            held.append(row)
            size += n
    if held:
        yield held


def encode(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id, ids, decoded``: ids as little-endian unsigned 32-bit integers,
    and the bytes that decoding them gives back."""
    def run(batches):
        import pyarrow as pa
        e = encoder(p)
        for rows in blocks(batches, 1, p.block_chars):
            ids = e.encode([r[1] for r in rows])
            for k in range(0, len(rows), 200):           # small batches back: ids are wide
                part = ids[k:k + 200]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[k:k + 200]], pa.int64()), pa.array(part, pa.binary()),
                                                  pa.array([e.decode(x) for x in part], pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The contract's rows: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return encode(docs, p).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                                  F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
