"""Runs of words against all periods by brute force, and the digests."""

import hashlib
import random
import time
import zlib
from fractions import Fraction

import pytest

from topicflow.llm import runs as R


def brute(words, p):
    found = {}
    for q in range(1, len(words) // p.repeats + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(p.min_length, p.repeats * q):
                found.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def document(r):
    words = []
    for _ in range(r.randint(0, 6)):
        part = [r.choice("abcdefgh"[:r.choice([1, 2, 3, 8])]) for _ in range(r.randint(1, 40))]
        words += (part * 7)[:r.randint(1, len(part) * r.randint(1, 7))]
    return words


@pytest.mark.parametrize("p", [R.Params(), R.Params(step=7), R.Params(min_length=2, repeats=2, step=13), R.Params(min_length=3), R.Params(min_length=10, repeats=2),
                               R.Params(repeats=4, step=100)])
def test_against_brute_force(p):
    r = random.Random(5)
    seen = 0
    for _ in range(80):
        docs = [document(r) for _ in range(r.randint(0, 5))]
        want = [brute(d, p) for d in docs]
        assert R.catch(docs, p) == want
        seen += sum(map(len, want))
    assert seen > 20


def test_words_are_compared_when_hashes_meet(monkeypatch):
    monkeypatch.setattr(R, "mix", lambda ids: (ids % 3).astype("uint64"))      # many words look alike
    r = random.Random(1)
    for _ in range(60):
        d = document(r)
        got = {x for x in R.catch([d])[0]}
        assert got <= {(s, n, q) for s, n, q in brute(d, R.Params())} | {x for x in got if brute(d[x[0]:x[0] + x[1]], R.Params())}
        for s, n, q in got:
            assert all(d[i] == d[i + q] for i in range(s, s + n - q))


def test_long_documents_in_time():
    began = time.time()
    assert R.catch([["a"] * 300_000])[0] == [(0, 300_000, 1)]
    assert R.catch([["a", "b"] * 100_000])[0] == [(0, 200_000, 2)]
    r = random.Random(2)
    words = [str(r.randrange(50_000)) for _ in range(30_000)]
    assert R.catch([[*words, *words, *words, "end"]])[0] == [(0, 90_000, 30_000)]
    assert time.time() - began < 20


def test_query_rows(spark):
    r = random.Random(8)
    rows = [(i, r.choice([" ", "\n", "\t "]).join(document(r))) for i in range(120)]
    rows += [(None, "x " * 50), (None, None), (3, None), (5, ""), (7, "y y"), (7, "y y"), (9, "q q " * 30), (-11, " z " * 24)]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, runs int, start string")
    got = [tuple(x) for x in R.digests(R.periodic_runs(R.planted(docs), R.Params(step=50, block_chars=400))).collect()]
    want = []
    for i, text in rows:
        w = [x.decode() for x in (text or "").encode().split()]
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute(w, R.Params())
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                     sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(x[1] > 0 for x in want) > 10
    assert R.digests(R.periodic_runs(docs.limit(0))).count() == 0
