"""Hits against a direct scan of every window at every place."""

import hashlib
import random
import re

import pytest

from topicflow.llm import decontam as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain(docs, items, width=10, slack=0):
    out = []
    wins = {}
    for item, t in items:
        w = words(t)
        if w:
            for i in range(max(1, len(w) - width + 1)):
                wins.setdefault(tuple(w[i:i + width]), set()).update([] if item is None else [str(item)])
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for win, owners in wins.items():
            for s in range(-slack, len(w)):
                if all(any(0 <= s + k + e < len(w) and w[s + k + e] == x for e in range(-slack, slack + 1)) for k, x in enumerate(win)):
                    hit |= set(range(max(0, s - slack), min(len(w), s + len(win) + slack)))
                    found |= owners
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=repr)


def data(seed=2):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["Été", "naïve", "日本", "a"]
    text = lambda n: " ".join(r.choice(vocab) + r.choice(["", ",", ".", "-"]) for _ in range(n))
    items = [(i, text(r.choice([2, 5, 10, 11, 30]))) for i in range(25)] + [(3, "w1 w2 w3"), (90, None), (91, "..."), (None, "w1 w1"), (None, "only w2 here"), (9, "a a")]
    docs = []
    for i in range(60):
        t = text(r.choice([0, 1, 8, 60, 200]))
        if i % 3 == 0:
            t += " " + r.choice(items[:25])[1].upper() + " " + text(7)
        docs.append((i, t))
    return docs + [(100, None), (101, ""), (101, "a a a a a"), (None, items[4][1]), (5, docs[3][1]), (5, docs[3][1]), (102, "x only w2 here")], items


@pytest.mark.parametrize("p", [D.Params(), D.Params(shard_words=50, block_bytes=300), D.Params(slack=1), D.Params(slack=2, block_bytes=400)])
def test_against_a_scan(spark, p):
    docs, items = data()
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted((tuple(r) for r in D.decontaminate(df, bench, p).collect()), key=repr)
    want = plain(docs, items, p.width, p.slack)
    assert got == want
    clean = D.keep_clean(df, bench, p)
    assert clean.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(x[0]) for x in want if not x[5])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in D.decontaminate(docs, none).collect()] == [0]
    assert D.decontaminate(docs.limit(0), none).count() == 0
