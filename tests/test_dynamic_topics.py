"""Coupled time slices against a plain version, and drifting topics planted in a corpus."""

import numpy as np
import pytest
import xxhash

from topicflow.operators import dynamic_topics as D

SLICES, K = 5, 2


def drifting(seed=1, docs=12, words=30):
    """Two topics whose words change a third of their weight from slice to slice."""
    r = np.random.default_rng(seed)
    n_terms = 60
    logit = r.normal(0, 1.5, (K, n_terms))
    logit[0, :30] += 3
    logit[1, 30:] += 3
    rows = []
    for s in range(SLICES):
        phi = np.exp(logit) / np.exp(logit).sum(1, keepdims=True)
        for d in range(docs):
            theta = r.dirichlet([0.2, 0.2])
            rows += [(s * 1000 + d, s, f"t{t}") for t in r.choice(n_terms, words, p=theta @ phi)]
        logit = logit + r.normal(0, 0.25, logit.shape)
    return rows


def plain(rows, slices, p):
    """The same alternation over dense arrays."""
    terms = sorted({t for _, _, t in rows})
    at = {t: i for i, t in enumerate(terms)}
    docs = {}
    for i, s, t in rows:
        docs.setdefault((i, s), {}).setdefault(at[t], 0)
        docs[i, s][at[t]] += 1
    freq = np.zeros(len(terms))
    for d in docs.values():
        for t, n in d.items():
            freq[t] += n

    def bend(t, k):
        h = xxhash.xxh64_intdigest(t.encode(), 42)
        for x in (k, p.seed):
            h = xxhash.xxh64_intdigest(int(x).to_bytes(4, "little"), h)
        return 0.5 + h % (1 << 20) / (1 << 20)

    w = np.array([[bend(t, k) * freq[at[t]] for k in range(p.k)] for t in terms])
    phi = np.repeat((w / w.sum(0))[None], slices, 0)
    for i in range(p.warm + p.iterations):
        c = np.zeros((len(terms), slices, p.k))
        for (_, s), d in docs.items():
            x = np.array(sorted(d))
            c[x, s] += D.mixture(np.array([d[t] for t in x], float), phi[s][x], p)[1]
        now = D.Params(**{**p.__dict__, "drift": 0.0}) if i < p.warm else p
        seen = c.sum((1, 2)) >= 0
        w = np.exp(D.smooth(c[seen], c.sum(0), now, len(terms)))
        phi = (w / w.sum(0)).transpose(1, 0, 2)
    return {(s, t): phi[s, at[t]] for s in range(slices) for t in terms}


def frame(spark, rows):
    return D.bags(spark.createDataFrame(rows, "doc_id long, slice int, term string"), "slice")


@pytest.mark.parametrize("slices", [1, 3])
def test_against_plain(spark, slices):
    rows = [(i, s % slices, t) for i, s, t in drifting(docs=6)]
    p = D.Params(k=K, warm=2, iterations=2, rounds=5)
    got = {(r["slice"], r["term"]): r["phi"] for r in D.fit(frame(spark, rows), slices, p).collect()}
    want = plain(rows, slices, p)
    assert set(got) == set(want)
    for key, w in want.items():
        assert np.allclose(got[key], w, rtol=1e-6, atol=1e-12)


def test_documents_of_a_batch_are_found_together():
    """Many documents at once, of one term and of many, as one by one."""
    r = np.random.default_rng(3)
    p = D.Params(k=4, rounds=7)
    size = np.array([1, 5, 1, 40, 2])
    n, phi, at = r.poisson(2, size.sum()) + 1.0, r.dirichlet(np.ones(4), size.sum()), np.append(0, size.cumsum()[:-1])
    want = np.concatenate([D.mixture(n[a:a + s], phi[a:a + s], p)[1] for a, s in zip(at, size)])
    assert np.allclose(D.mixtures(n, phi, at, p), want, rtol=1e-12)


def test_expected_counts_of_tables(spark):
    """More documents than go into one step, of every slice; the sums are those of each document alone."""
    r = np.random.default_rng(5)
    p = D.Params(k=3, rounds=4)
    docs = [(i, i % 3, sorted({f"t{t}" for t in r.integers(0, 30, r.integers(1, 9))})) for i in range(700)]
    bag = [(i, s, t, 1 + (i + len(t)) % 3) for i, s, terms in docs for t in terms]
    phi = {(s, f"t{t}"): r.dirichlet(np.ones(3)).tolist() for s in range(3) for t in range(30)}
    got = D._expected(spark.createDataFrame(bag, "id long, slice int, term string, n long"),
                      spark.createDataFrame([(*k, v) for k, v in phi.items()], "slice int, term string, phi array<double>"), p)
    want = {}
    for i, s, terms in docs:
        c = D.mixture(np.array([n for j, _, _, n in bag if j == i], float), np.array([phi[s, t] for t in terms]), p)[1]
        for t, row in zip(terms, c):
            want[s, t] = want.get((s, t), 0) + row
    rows = {(x["slice"], x["term"]): x["c"] for x in got.collect()}
    assert set(rows) == set(want) and all(np.allclose(rows[k], want[k], rtol=1e-9) for k in want)


def smoothed_by_solving(y, exposure, drift):
    """The mode of the walk's posterior by Newton steps on all slices at once."""
    n = len(y)
    step = np.diff(np.eye(n), axis=0)
    prior = step.T @ step / drift
    b = np.log(y / exposure)
    for _ in range(200):
        rate = exposure * np.exp(b)
        b = b + np.clip(np.linalg.solve(np.diag(rate) + prior, y - rate - prior @ b), -1, 1)
    return b


def test_smoothing_finds_the_posterior_mode():
    r = np.random.default_rng(0)
    p = D.Params(k=1, passes=60, eta=0.05)
    counts = r.poisson(6, (8, 7, 1)).astype(float)
    counts[0], counts[1, 3] = 0, 0
    totals = counts.sum(0) + 50
    got = D.smooth(counts, totals, p, 8)
    for i in range(8):
        want = smoothed_by_solving(counts[i, :, 0] + p.eta, totals[:, 0] + p.eta * 8, p.drift)
        assert np.allclose(got[i, :, 0], want, atol=1e-4)
    one = D.smooth(counts[:, :1], totals[:1], p, 8)                       # one slice: no walk
    assert np.allclose(np.exp(one), (counts[:, :1] + p.eta) / (totals[:1] + 8 * p.eta))


def test_linked_slices_beat_single_ones(spark):
    """Held-out likelihood on planted drifting topics; topic numbers last."""
    train, test = drifting(docs=14), drifting(docs=40)
    test = [(i + 100_000, s, t) for i, s, t in test if i % 1000 >= 14]
    p = D.Params(k=K, warm=3, iterations=3, rounds=8)
    bag = frame(spark, test)

    def score(phi):
        r = D.held_out(bag, phi, p).agg({"log_likelihood": "sum", "n": "sum"}).first()
        return r["sum(log_likelihood)"] / r["sum(n)"]

    linked = D.fit(frame(spark, train), SLICES, p)
    alone = None
    for s in range(SLICES):
        one = D.fit(frame(spark, [(i, 0, t) for i, x, t in train if x == s]), 1, p).selectExpr(f"{s} as slice", "term", "phi")
        alone = one if alone is None else alone.unionByName(one)
    shared = alone.select("slice", "term")                               # judged on the terms both know
    assert score(linked.join(shared, ["slice", "term"])) > score(alone) + 0.01
    top = {}
    for r in D.top_terms(linked, 8).collect():
        top.setdefault((r["slice"], r["topic"]), set()).add(r["term"])
    assert all(len(top[s, k] & top[s + 1, k]) > len(top[s, k] & top[s + 1, 1 - k]) for s in range(SLICES - 1) for k in range(K))


def test_a_block_asks_for_a_term_once(spark):
    """Documents of two blocks and two slices: one row for each block and term, and the sums of ``mixture``."""
    r = np.random.default_rng(8)
    bag = [(i, i % 2, f"t{t}", int(r.integers(1, 4))) for i in range(300) for t in r.choice(12, 5, replace=False)] + [(None, 1, "t0", 2), (7, 1, "unknown", 1)]
    bag = spark.createDataFrame(bag, "id long, slice int, term string, n long")
    p = D.Params(k=2, rounds=4, block=1000)
    blocks, terms = D._blocks(bag, p)
    assert terms.count() <= 13 * blocks.count() < 300 and terms.count() == terms.select("slice", "block", "term").distinct().count()
    phi = {(s, f"t{t}"): r.random(2) for s in range(2) for t in range(12)}
    table = spark.createDataFrame([(s, t, [float(v) for v in x]) for (s, t), x in phi.items()], "slice int, term string, phi array<double>")
    want, docs = {}, {}
    for x in bag.where("term <> 'unknown'").collect():
        docs.setdefault((x["id"], x["slice"]), []).append((x["term"], x["n"]))
    for (_, s), rows in docs.items():
        c = D.mixture(np.array([n for _, n in rows], float), np.array([phi[s, t] for t, _ in rows]), p)[1]
        for (t, _), v in zip(rows, c):
            want[s, t] = want.get((s, t), 0) + v
    got = {(x["slice"], x["term"]): x["c"] for x in D._expected(bag, table, p).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
