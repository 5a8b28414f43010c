"""Letter profiles against a plain computation."""

import math
from collections import Counter

from topicflow.operators import language_profiles as P

ROWS = [(1, "en", ["the", "thing", "other"]), (2, "de", ["der", "die", "das", "ding"]), (3, "en", ["this", "that", "the", "the"]),
        (4, None, ["dies", "that"]), (5, "de", []), (6, "en", None), (7, None, ["zzz", "qqq"]), (8, "fr", ["l", "été", "😀ab"]),
        (9, "de", ["", "die"]), (10, None, ["x" * 50_000])]


def cut(w, n):
    s = f" {w} "
    return [s[i:i + n] for i in range(max(len(s) - n, 0) + 1)]


def plain(rows, n):
    prof = {}
    for _, lang, words in rows:
        for w in words or []:
            if lang is not None and w:
                prof.setdefault(lang, Counter()).update(cut(w, n))
    v = len(set().union(*prof.values())) if prof else 0
    out = {}
    for i, _, words in rows:
        g = [x for w in words or [] if w for x in cut(w, n)]
        score = {lang: sum(round(math.log(c[x] + 1) * 1e6) for x in g) - len(g) * round(math.log(sum(c.values()) + v) * 1e6) for lang, c in prof.items()}
        out[i] = min(score.items(), key=lambda x: (-x[1], x[0])) if g and score else (None, None)
    return out


def test_against_plain(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, lang string, tokens array<string>")
    for n in (2, 3, 5):
        got = {r["doc_id"]: r for r in P.classify(df, P.learn(df, n=n), n=n).collect()}
        want = plain(ROWS, n)
        assert set(got) == set(want)
        for i, (lang, score) in want.items():
            assert got[i]["detected_lang"] == lang, (n, i)
            assert (got[i]["score"] is None) == (score is None) and (score is None or abs(got[i]["score"] * 1e6 - score) < 0.5)


def test_repeats_and_empty(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, lang string, tokens array<string>")
    profile = P.learn(df)
    twice = {r["doc_id"]: r["detected_lang"] for r in P.classify(df.union(df), profile).collect()}
    assert twice == {i: lang for i, (lang, _) in plain(ROWS, 3).items()}
    assert P.classify(df.limit(0), profile).count() == 0
    assert [r["detected_lang"] for r in P.classify(df, P.learn(df.limit(0))).collect()] == [None] * len(ROWS)
