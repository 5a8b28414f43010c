"""Ranked search against scoring every document by hand."""

import math
import random
import re
from collections import Counter

import pytest

from topicflow.llm import search as S

UPPER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items, k):
    cut = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for _, _, n in cut), sum(n for _, _, n in cut)
    df = Counter(t for _, c, _ in cut for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in cut:
            m = 25 + 75 * n * n_docs // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def corpus():
    r = random.Random(3)
    pool = [f"w{i}" for i in range(400)] + ["café", "日本", "a1b2", "THE", "The"]
    text = lambda: r.choice([" ", ", ", "-", "  "]).join(r.choice(pool[:r.choice([5, 40, 405])]) for _ in range(r.randint(0, 60)))
    docs = [(r.randrange(10 ** 12), text()) for _ in range(300)]
    docs += [(1000 + i, docs[0][1]) for i in range(25)] + [(None, docs[1][1]), (None, None), (7, None), (8, ""), (9, "... !"), (10, "w1 " * 5000), (10, "w1 " * 5000)]
    items = [(i, text()) for i in range(30)] + [(50, docs[0][1]), (50, docs[0][1]), (None, docs[1][1]), (51, None), (52, "!!"), (53, "nowhere"), (54, "the THE The"),
                                                (55, " ".join(f"w{i}" for i in range(400)))]
    return docs, items


@pytest.mark.parametrize("p", [S.Params(), S.Params(block_docs=17, bundle=4, k=3), S.Params(block_terms=300, owners=(0.02,)), S.Params(owners=(), block_docs=40)])
def test_against_all_documents(spark, p):
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, block int").repartition(3)
    q = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, q int")
    got = [tuple(x) for x in S.ranked(d, q, p).collect()]
    assert sorted(got, key=repr) == sorted(brute(docs, items, p.k), key=repr)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert S.ranked(d.limit(0), q).count() == 0 and S.ranked(d, q.limit(0)).count() == 0
    assert [tuple(x) for x in S.ranked(d, q).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]


def test_index_reads_by_term(spark, tmpdir_path):
    d = spark.createDataFrame([(i, f"common t{i}") for i in range(50)], "doc_id long, text string").coalesce(1)
    S.build(d, tmpdir_path + "/index", S.Params(block_docs=20))
    rows = S.load(spark, tmpdir_path + "/index")
    assert rows.where("term is null").count() == 3
    assert rows.where("term = cast('common' as binary)").agg({"df": "sum"}).first()[0] == 50
