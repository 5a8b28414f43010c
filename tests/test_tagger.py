"""The tagger against every path of tags, and an ambiguous word in two contexts."""

import itertools
import random

import numpy as np
import pytest

from topicflow.operators import tagger as G

LEX = [("the", "DT", 50.0), ("a", "DT", 30.0), ("dog", "NN", 9.0), ("cat", "NN", 8.0), ("walk", "NN", 5.0), ("walk", "VB", 5.0),
       ("they", "PR", 20.0), ("we", "PR", 20.0), ("sleep", "VB", 9.0), ("run", "VB", 7.0), ("run", "NN", 1.0)]


def frames(spark, docs):
    return (spark.createDataFrame(docs, "doc_id long, tokens array<string>"),
            spark.createDataFrame(LEX, "term string, tag string, weight double"))


def paths(e, m):
    k = len(m.tags)
    e = np.asarray(e).reshape(-1, k)
    for path in itertools.product(range(k), repeat=len(e)):
        p = m.start[path[0]] * e[0, path[0]]
        for n in range(1, len(e)):
            p *= m.step[path[n - 1], path[n]] * e[n, path[n]]
        yield path, p


def test_counts_and_paths_against_enumeration():
    r = np.random.default_rng(1)
    m = G.TagModel(("a", "b", "c"), r.dirichlet(np.ones(3)), r.dirichlet(np.ones(3), 3))
    docs = [r.random(3 * n) for n in (1, 4, 6, 2, 6, 1, 3)]
    want = np.zeros((4, 3))
    for e in docs:
        found = list(paths(e, m))
        whole = sum(p for _, p in found)
        for path, p in found:
            want[0, path[0]] += p / whole
            for x, y in itertools.pairwise(path):
                want[1 + x, y] += p / whole
    assert np.allclose(G.expected_counts(docs, m), want)
    best = [[m.tags[t] for t in max(paths(e, m), key=lambda x: x[1])[0]] for e in docs]
    assert G.best_tags(docs, m) == best
    assert all(np.allclose(G.expected_counts(docs, m), sum(G.expected_counts([e], m) for e in docs)) for _ in range(1))


def test_ambiguous_word_follows_its_context(spark):
    r = random.Random(3)
    noun, verb = ["dog", "cat", "walk"], ["sleep", "run", "walk"]
    docs = []
    for i in range(200):
        s = [r.choice(["the", "a"]), r.choice(noun), r.choice(verb)] if i % 2 else [r.choice(["they", "we"]), r.choice(verb), r.choice(["the", "a"]), r.choice(noun)]
        docs.append((i, s))
    docs += [(900, ["the", "walk", "run"]), (901, ["we", "walk", "the", "dog"]), (902, []), (903, None), (904, [None, "the", "zebra", "run"])]
    df, lex = frames(spark, docs)
    m = G.fit(df, lex)
    assert np.allclose(m.step.sum(axis=1), 1) and np.isclose(m.start.sum(), 1)
    tagged = G.tag(df, lex, m)
    got = {x["doc_id"]: list(x["tags"]) for x in tagged.collect()}
    assert got[900] == ["DT", "NN", "VB"] and got[901] == ["PR", "VB", "DT", "NN"]
    assert got[904] == ["DT", "NN", "VB"]                       # an unknown word by its place
    assert 902 not in got and 903 not in got and len(got) == 203
    kept = {x["doc_id"]: list(x["tokens"]) for x in G.keep_tags(tagged).collect()}
    assert kept[900] == ["walk"] and kept[901] == ["dog"]


def test_long_and_empty(spark):
    m = G.TagModel(("a", "b"), np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.2, 0.8]]))
    long = np.tile([0.3, 0.7], 250_000)
    assert len(G.best_tags([long, [0.1, 0.9]], m)[0]) == 250_000
    assert np.isclose(G.expected_counts([long], m).sum(), 250_000)
    df, lex = frames(spark, [(1, ["the"])])
    assert G.tag(df.limit(0), lex, m).count() == 0
    with pytest.raises(ValueError):
        G.fit(df, lex.limit(0))


def test_the_query_finds_emissions_once(spark, monkeypatch):
    from topicflow.operators import tagger
    from topicflow.plans import registry
    registry.load_all()
    calls, emissions = [], tagger.emissions
    monkeypatch.setattr(tagger, "emissions", lambda *a, **k: calls.append(1) or emissions(*a, **k))
    docs = spark.createDataFrame([(i, "running and walking dogs walked home slowly " * 8) for i in range(9)], "doc_id long, text string")
    import topicflow.plans.q_lexicon as Q
    monkeypatch.setattr(Q, "read_table", lambda *_: docs)
    rows = registry.QUERIES["k3_context_tags"](spark, "").collect()
    assert len(rows) == 9 and len({(r["tags"], r["nouns"]) for r in rows}) == 1 and len(rows[0]["tags"].split()) == 56 and len(calls) == 1
