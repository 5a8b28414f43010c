"""Held-out accuracy, planted misspellings and degenerate rows."""

import random

from pyspark.sql import functions as F

from topicflow.llm import toxicity as T

P = T.Params(per_class=300)
SMALL = "doc_id long, text string, score string, extra int"


def corpus(n=900, seed=3):
    r = random.Random(seed)
    syll = ["ba", "lo", "ri", "ten", "mu", "sha", "ver", "co", "pi", "dan"]
    word = lambda: "".join(r.choice(syll) for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randint(20, 120))]
        toxic = int(i % 3 == 0)
        if toxic:
            for _ in range(2 + len(w) // 30):
                w.insert(r.randrange(len(w)), "grumpf" + r.choice(syll))
        rows.append((i, " ".join(w), "x", 1))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_accuracy_and_unseen_misspellings(spark):
    rows, labels = corpus()
    rows.append((5000, "ba lo riten mu sha ver co pi dan grumpfzz ba lo pipi", "x", 1))
    docs, lab = spark.createDataFrame(rows, SMALL), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in T.toxicity(docs, lab, P).collect()}
    truth = dict(labels)
    held = [r for r in out.values() if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 100
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert out[5000]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 for r in out.values())
    kept = T.keep_clean(docs, lab, P)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["predicted"] == 0 for r in out.values())


def test_nulls_empty_tables_and_repeats(spark):
    docs = spark.createDataFrame([(None, None, "a", 1), (1, "", "a", 1), (1, "", "a", 1), (2, "!!! ---", None, None),
                                  (3, "wort " * 50_000, "b", 2)], SMALL)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = T.toxicity(docs, none, P).collect()
    assert len(rows) == 5 and len({r["score"] for r in rows}) == 1
    assert T.toxicity(docs.limit(0), none, P).count() == 0
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 1)], "doc_id long, toxic int")
    assert T.toxicity(docs, odd, P).count() == 5


def test_held_out_fold(spark):
    import zlib
    rows = spark.range(50).select("id", T.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)
