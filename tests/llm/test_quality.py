"""Base statistics against plain counting; outliers against a planted mixture."""

import math
import random
import re

import pytest

from topicflow.llm import quality as Q

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, d2 int"


def plain(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i:i + 3]), []).append(i)
    hit = {k for v in grams.values() if len(v) > 1 for i in v for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def corpus(n=700, seed=8):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 9)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(r.randint(40, 300))]
        t = "".join(x + r.choice([" "] * 9 + ["\n", "\t "]) for x in w)
        if i % 50 == 0:
            t = " ".join(x + r.choice(["%%%", "***", "|"]) for x in w)
        elif i % 9 == 0:
            t += "\n" + "\n".join(t.split("\n")[:3])
        rows.append((i, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", None])))
    return rows + [(900, None, "en", "s1"), (901, "", None, None), (902, "a b", "en", "s1"), (902, "a b", "en", "s1"),
                   (903, "one two three " * 2000, "en", "s1"), (None, rows[1][1], "xx", "once")]


def test_against_plain_counts(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in Q.quality(docs).collect()), key=repr)
    assert [g[:7] for g in got] == sorted(((i, *plain(t)) for i, t, _, _ in rows), key=lambda x: repr(x))
    failed = {g[0]: g[6] for g in got}
    assert not any(g[7] and failed[g[0]] for g in got)


def clean(r, n=None):
    """Prose of one kind: words of six letters on average, no line twice, few symbols."""
    word = lambda: "".join(r.choice("abcdefghijklmn") for _ in range(r.randint(3, 9)))
    text = " ".join(word() + ("." if k % 11 == 10 else "") + ("\n" if k % 40 == 39 else "") for k in range(n or int(r.lognormvariate(5.2, 0.3)) + 55))
    return text + " &" if r.random() < 0.1 else text


OUTLIERS = {
    "length": lambda r: clean(r, 30_000),
    "word length": lambda r: " ".join("".join(r.choice("abcdefghijklmn") for _ in range(r.randint(12, 20))) for _ in range(200)),
    "symbols": lambda r: " ".join(w + r.choice(["%%", "**", "|"]) for w in clean(r, 180).split()),
    "duplicate lines": lambda r: clean(r, 180) + "\n" + "\n".join(r.choice("xyz") + str(k % 9) for k in range(60)),
    "repeated words": lambda r: (lambda t: t + " " + " ".join(t.split()[:40]))(clean(r, 150)),
}


def test_an_outlier_in_each_statistic_goes(spark):
    rows, r = [], random.Random(3)
    for k, kind in enumerate(OUTLIERS):                            # a group of its own for each statistic
        rows += [(1000 * k + i, clean(r) if i < 400 else OUTLIERS[kind](r), kind, "s1") for i in range(412)]
    got = {x["doc_id"]: x for x in Q.quality(spark.createDataFrame([(*x, "x", 1) for x in rows], SCHEMA)).collect()}
    for k, kind in enumerate(OUTLIERS):
        assert not any(got[1000 * k + i]["base_failed"] or got[1000 * k + i]["kept"] for i in range(400, 412)), kind
        assert sum(got[1000 * k + i]["kept"] for i in range(400)) >= 0.98 * 400, kind


def test_concentration_lowers_the_determinant(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in corpus(400)], SCHEMA)
    rows = Q.vector(Q.statistics(docs)).where("not base_failed and g1 = '=en' and g2 = '=s1'").cache()
    det = lambda e: math.prod(e[f"l{i}{i}"] for i in range(5))
    out = [det(Q.estimate(rows, Q.Params(steps=k, lean=0)).first()) for k in (1, 2, 4, 8)]
    assert all(b <= a * 1.02 for a, b in zip(out, out[1:]))


@pytest.mark.parametrize("q", [0.5, 0.75, 0.99, 1 - 1e-9])
def test_chi_square(q):
    assert abs(Q.chi2_cdf(Q.chi2_quantile(q, 5), 5) - q) < 1e-9
    assert abs(Q.chi2_quantile(0.99, 5) - 15.0863) < 1e-3


def test_empty(spark):
    assert Q.quality(spark.createDataFrame([], SCHEMA)).count() == 0
