"""Fingerprints and components against a plain all-pairs computation."""

import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from topicflow.llm import simhash as S

TINY = S.Params(tile=7, block=4)


def plain_fingerprint(text, size=4):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    w = [x for x in t.split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))]
    h = [xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def corpus(n=120, seed=5):
    r = random.Random(seed)
    words = ["Word%d" % i for i in range(300)] + ["É", "x y", "\x1cq"]
    base = [[r.choice(words) for _ in range(r.choice([1, 3, 4, 9, 80, 300]))] for _ in range(n)]
    rows = []
    for i, w in enumerate(base):
        rows.append((1000 - i, r.choice([" ", "\n", " \t "]).join(w)))
        if i % 4 == 0:
            near = list(w)
            near[r.randrange(len(near))] = "other"
            rows += [(3000 + i, " ".join(near)), (5000 + i, " ".join(w).upper())]
    return rows + [(7, None), (8, ""), (9, " \n "), (7000, "same"), (7000, "same")]


def test_fingerprints_are_the_majority_bits():
    for _, t in corpus(40):
        assert S.fingerprint(S.shingle_hashes(t, 4)) == plain_fingerprint(t)


def test_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 2 ** 63, 30, dtype=np.uint64)
    fps = [int(s) for s in seeds]
    for s in seeds:
        for _ in range(rng.integers(0, 12)):
            bits = rng.choice(64, rng.integers(1, 6), replace=False)
            fps.append(int(s) ^ sum(1 << int(b) for b in bits))
    fps = sorted(set(fps))
    x = np.array(fps, np.uint64)
    pairs = S.links(x, None, TINY)
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    at = {f: i for i, f in enumerate(fps)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in pairs:
        a, b = sorted((find(at[a]), find(at[b])))
        root[b] = a
    assert [find(i) for i in range(len(fps))] == plain_components(fps)
    left, right = set(fps[:40]), set(fps[40:])
    between = S.links(x[:40], x[40:], TINY)
    assert all(a in left and b in right and (a ^ b).bit_count() <= 4 for a, b in between)
    assert {a for a, _ in between} <= {a for a in left for b in right if (a ^ b).bit_count() <= 4}


@pytest.mark.parametrize("p", [TINY, S.Params()])
def test_query_rows(spark, p):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, fp int, th string")
    got = sorted(tuple(r) for r in S.simhash(docs, p).collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(fps)
    least = {}
    for (i, _), r in zip(rows, roots):
        least[r] = min(i, least.get(r, i))
    assert got == sorted((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, roots))
    kept = S.keep_one(docs, p)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))


def test_long_chain_null_ids_and_empty(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 501)]
    pairs = spark.createDataFrame(chain, "a long, b long")
    got = {r["v"]: r["root"] for r in S.components(pairs).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, "solo text")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in S.simhash(docs).collect()) == [(-1, -1), (-1, 4), (4, 4)]
    assert S.keep_one(docs).count() == 2
    assert S.simhash(docs.limit(0)).count() == 0
