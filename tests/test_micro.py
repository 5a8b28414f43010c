"""Hand-computed micro cases (FIXTURES.md) and operator properties."""

import itertools

import pytest
from pyspark.sql import functions as F

from topicflow.functions import text as T
from topicflow.operators import coherence as Q
from topicflow.operators import collocations, filters, lexicon, results as R, timebins as TB


def one(spark, expr_col, value):
    return spark.createDataFrame([(value,)], "s string").select(expr_col("s").alias("o")).first()["o"]


def test_letter_and_phrase_repetition(spark):
    assert one(spark, T.t4_letter_repeat, "sooo") == "so"
    assert one(spark, T.t12_phrase_repeat, "banana") == "bana"
    assert one(spark, T.t5_nonword_repeat, "a!!!b  c") == "a!b c"
    assert one(spark, T.t1_split_camel, "fooBar") == "foo. Bar"
    assert one(spark, T.t15_ascii_letters, " don't  stop-é ") == "don t stop"


def _topics(spark, rows):
    return spark.createDataFrame(rows, "topic string, rank long, term string")


def test_diversity_and_uniqueness(spark):
    t = _topics(spark, [("t0", 0, "a"), ("t0", 1, "b"), ("t1", 0, "b"), ("t1", 1, "c")])
    assert abs(Q.diversity(t, topk=2).first()["diversity"] - 0.75) < 1e-12
    assert abs(Q.uniqueness(t).first()["uniqueness"] - 0.75) < 1e-12


def _win(spark, tokens, topics, w):
    corpus = spark.createDataFrame([(1, tokens)], "doc_id long, tokens array<string>")
    return Q.window_stats(corpus, _topics(spark, topics), [], "sliding", w)


def test_short_document_is_one_window(spark):
    st = _win(spark, ["a", "b", "c"], [("t", 0, "a"), ("t", 1, "b")], 10)
    assert st.totals.first()["n_windows"] == 1
    assert st.pairs.first()["n_ab"] == 1


def test_window_count(spark):
    st = _win(spark, ["a", "x", "x", "a"], [("t", 0, "a"), ("t", 1, "x")], 2)
    assert st.totals.first()["n_windows"] == 3
    singles = {r["term"]: r["n_term"] for r in st.singles.collect()}
    assert singles["a"] == 2 and singles["x"] == 3
    assert st.pairs.first()["n_ab"] == 2


def test_window_counts_match_brute_force(spark):
    import random
    rnd = random.Random(5)
    vocab = list("abcdefg")
    docs = [(i, [rnd.choice(vocab) for _ in range(rnd.randint(1, 30))]) for i in range(40)]
    topics = [("t", r, v) for r, v in enumerate("abcd")]
    corpus = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    for kind, size in (("sliding", 5), ("sliding", 12), ("centred", 2)):
        st = Q.window_stats(corpus, _topics(spark, topics), [], kind, size)
        W, single, pair = 0, {}, {}
        for _, toks in docs:
            if not set(toks) & set("abcd"):
                continue
            n = len(toks)
            if kind == "sliding":
                wins = [set(toks[s:s + size]) for s in range(max(1, n - size + 1))]
            else:
                wins = [set(toks[max(0, c - size):c + size + 1]) for c in range(n)]
            W += len(wins)
            for win in wins:
                for a in "abcd":
                    single[a] = single.get(a, 0) + (a in win)
                for a, b in itertools.combinations("abcd", 2):
                    pair[(a, b)] = pair.get((a, b), 0) + (a in win and b in win)
        assert st.totals.first()["n_windows"] == W
        assert {r["term"]: r["n_term"] for r in st.singles.collect()} == {k: v for k, v in single.items() if v}
        got = {(r["a"], r["b"]): r["n_ab"] for r in st.pairs.collect()}
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in pair.items() if v}


def test_npmi_in_range(spark):
    docs = [(i, list("abcab" if i % 2 else "cddc")) for i in range(10)]
    corpus = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    t = _topics(spark, [("t", 0, "a"), ("t", 1, "b"), ("t", 2, "c"), ("u", 0, "d"), ("u", 1, "c")])
    for r in Q.npmi(corpus, t, window=3).collect():
        assert -1.0 <= r["npmi"] <= 1.0


def test_time_bins(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "x double")
    got = sorted((r["x"], r["bin"]) for r in TB.equal_width_bins(df, "x", 2).collect())
    assert got == [(0.0, 1), (5.0, 1), (10.0, 2)]
    counts = {r["bin"]: r["n"] for r in TB.counts_per_bin(TB.equal_width_bins(df, "x", 4), 4).collect()}
    assert counts == {1: 1, 2: 1, 3: 0, 4: 1}


def test_topic_count_resolution(spark):
    df = spark.createDataFrame([({"nr_topics": "0", "num_topics": "20"},), ({"n_components": "7"},), ({},)],
                               "Params map<string,string>")
    assert [r["k"] for r in df.select(R.resolve_topic_count().alias("k")).collect()] == [20, 7, None]


def test_top_three_marking(spark):
    df = spark.createDataFrame([(f"m{i}", float(v)) for i, v in enumerate([3, 3, 2, 1, 0])], "Model string, v double")
    marks = {r["Model"]: r["mark"] for r in R.top_three(df, ["v"]).collect()}
    assert [marks[f"m{i}"] for i in range(5)] == [1, 1, 2, 3, None]


def test_greedy_collocation_apply(spark):
    long = spark.createDataFrame([(1, p, t) for p, t in enumerate("a b c a b".split())], "doc_id long, pos int, term string")
    ph = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    out = [r["term"] for r in collocations.apply(long, ph).orderBy("pos").collect()]
    assert out == ["a_b", "c", "a_b"]


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def _alignment(a, b):
    """Optimal string alignment by recursion over the ends of both strings."""
    import functools

    @functools.cache
    def d(i, j):
        if not i or not j:
            return i + j
        best = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        return min(best, d(i - 2, j - 2) + 1) if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] else best
    return d(len(a), len(b))


def test_typo_correction_matches_brute_force(spark):
    import random
    rnd = random.Random(1)
    letters = "abcdefgh"
    dic = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))): rnd.randint(1, 50) for _ in range(60)}
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 10))) for _ in range(120)] + ["x", "xyz", "xyzw", "", "\u00e9"]
    for t in list(dic)[:30]:                             # neighbours swapped, once or twice
        i = rnd.randrange(len(t))
        swapped = t[:i] + t[i:i + 2][::-1] + t[i + 2:]
        words += [swapped, swapped[::-1][:2] + swapped[2:]]
    got = {r["word"]: (r["term"], r["distance"]) for r in lexicon.typo_candidates(
        spark.createDataFrame([(w,) for w in [*words, None]], "word string"),
        spark.createDataFrame([*dic.items(), (None, 9)], "term string, count long"), 3, 7).collect()}
    for w in set(words):
        cands = [(_alignment(w, t), -c, t) for t, c in dic.items() if _alignment(w, t) <= 3]
        if cands:
            d, _, t = min(cands)
            assert got.get(w) == (t, d), (w, got.get(w), (t, d))
        else:
            assert w not in got
    assert None not in got
    assert any(_lev(w, t) > d for w, (t, d) in got.items())


def test_typo_pairs_are_tested_in_the_join_but_swaps_after_it(spark):
    """Of the candidates only near ones reach the interpreted test of the swaps; swapped, they are right at every distance."""
    words = spark.createDataFrame([(w,) for w in ("ba", "badc", "badcfe", "badcfegh", "abcx\u00e9h", "\U0001F600bcdefgh")], "word string")
    terms = spark.createDataFrame([("abcdefgh", 5), ("abcdef", 4), ("abcd", 3), ("ab", 2)], "term string, count long")
    got = {r["word"]: (r["term"], r["distance"]) for r in lexicon.typo_candidates(words, terms, 3, 7).collect()}
    assert got == {"ba": ("ab", 1), "badc": ("abcd", 2), "badcfe": ("abcdef", 3), "badcfegh": ("abcdefgh", 3),
                   "abcx\u00e9h": ("abcdef", 3), "\U0001F600bcdefgh": ("abcdefgh", 1)}
    plan = lexicon._nearest(words, terms, 3, 7)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join Inner" in line and "key" in line]
    assert joins and all("levenshtein" in j and "exists" not in j and "reverse" not in j for j in joins), plan


def test_typo_search_has_no_empty_key(spark):
    """All short words meet all short terms in the empty key; only the best term of each length may."""
    words = spark.range(300).selectExpr("concat('a', chr(97 + id % 26), chr(97 + id % 23)) word").distinct()
    terms = spark.createDataFrame([("xyz", 5), ("zyx", 9), ("yy", 1), ("zz", 1)], "term string, count long")
    got = lexicon.typo_candidates(words.where("word not rlike '[xyz]'"), terms, 3, 7).collect()
    assert got and {(r["term"], r["distance"]) for r in got} == {("zyx", 3)}


def test_count_vectors_and_mixtures(spark):
    from collections import Counter

    from topicflow.operators import models
    rows = [(i, [f"w{(i * 7 + j * j) % 13}" for j in range(i % 9)]) for i in range(40)]
    corpus = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    terms = models.term_ids(corpus)
    name = {r["term_id"]: r["term"] for r in terms.collect()}
    assert sorted(name) == list(range(len(name))) and sorted(name.values()) == sorted({t for _, x in rows for t in x})
    got = {r["doc_id"]: r["features"] for r in models.count_vectors(corpus, terms).collect()}
    assert len(got) == len(rows)
    for i, tokens in rows:
        assert got[i].size == len(name)
        assert {name[k]: v for k, v in zip(got[i].indices.tolist(), got[i].values.tolist(), strict=True)} == Counter(tokens)
    assert models.term_ids(corpus, vocab_size=3).count() == 3
    few = models.count_vectors(corpus, models.term_ids(corpus, vocab_size=3)).collect()
    assert len(few) == len(rows) and all(v["features"].size == 3 for v in few)
    topics, model, feats = models.lda(corpus, 3, max_iter=3, top=4)
    assert topics.count() == 12 and {r["term"] for r in topics.collect()} <= set(name.values())
    sums = models.doc_topic_matrix(model, feats.where("doc_id % 9 > 0")).groupBy("doc_id").sum("prob").collect()
    assert sums and all(abs(r[1] - 1) < 1e-9 for r in sums)


def test_exact_sample_and_dense_index(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "doc_id").repartition(7)
    s = filters.exact_sample(df, 123, "doc_id", seed=9)
    ids = sorted(r["doc_id"] for r in s.collect())
    import hashlib
    expect = sorted(sorted(range(1000), key=lambda i: hashlib.md5(f"9:{i}".encode()).hexdigest())[:123])
    assert ids == expect
    idx = sorted(r["doc_index"] for r in filters.dense_index(df.orderBy("doc_id")).collect())
    assert idx == list(range(1000))
    assert filters.exact_sample(df, 5000, "doc_id").count() == 1000


def test_grid_density_matches_brute_force(spark):
    import math
    import random
    from topicflow.operators import density
    rnd = random.Random(2)
    pts = []
    for cx, cy, n in ((0.0, 0.0, 40), (3.0, 3.0, 30), (0.0, 3.0, 5)):
        pts += [(cx + rnd.gauss(0, 0.3), cy + rnd.gauss(0, 0.3)) for _ in range(n)]
    pts += [(rnd.uniform(-2, 5), rnd.uniform(-2, 5)) for _ in range(15)]
    rows = [(i, [x, y]) for i, (x, y) in enumerate(pts)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    eps, min_pts, min_size = 0.25, 3, 10
    got = {r["id"]: r["cluster"] for r in density.density_clusters(df, "v", eps, min_pts, min_size, "id", dims=2).collect()}
    # brute force of the same definition
    cell = {i: (math.floor(x / eps), math.floor(y / eps)) for i, (x, y) in enumerate(pts)}
    count = {}
    for c in cell.values():
        count[c] = count.get(c, 0) + 1
    dense = {c for c, n in count.items() if n >= min_pts}
    comp, seen = {}, set()
    for c in sorted(dense):
        if c in seen:
            continue
        stack, members = [c], []
        seen.add(c)
        while stack:
            a = stack.pop()
            members.append(a)
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    b = (a[0] + dx, a[1] + dy)
                    if b in dense and b not in seen:
                        seen.add(b)
                        stack.append(b)
        for m in members:
            comp[m] = min(members)
    groups = {}
    for i, c in cell.items():
        if c in comp:
            groups.setdefault(comp[c], []).append(i)
    expect_clusters = sorted(sorted(g) for g in groups.values() if len(g) >= min_size)
    got_clusters = {}
    for i, k in got.items():
        if k != -1:
            got_clusters.setdefault(k, []).append(i)
    assert sorted(sorted(g) for g in got_clusters.values()) == expect_clusters
    assert len(expect_clusters) >= 2


def test_nmf_error_falls_and_keeps_large_ids(spark):
    from topicflow.operators import models as M
    rows = [(2 ** 40 + d, t, float(n)) for d in range(12) for t, n in (("a", 1 + d % 3), ("b", d % 2), ("c", 2 * (d % 2)), ("d%d" % (d % 4), 1)) if n]
    counts = spark.createDataFrame(rows, "doc_id long, term string, n double")
    errors = [M.nmf_factors(counts, 3, max_iter=k, seed=1)[2][-1] for k in (0, 1, 2, 4)]
    assert all(b <= a + 1e-9 for a, b in zip(errors, errors[1:]))
    w, h, _ = M.nmf_factors(counts, 3, max_iter=2)
    assert w.agg({"id": "min"}).first()[0] == 2 ** 40 and all(x >= 0 for r in h.collect() for x in r["f"])


def test_density_labels_a_long_chain(spark):
    from topicflow.operators.density import density_clusters, label_components
    pts = spark.createDataFrame([(i, [float(i // 2), 0.0]) for i in range(600)], "id long, v array<double>")
    out = density_clusters(pts, "v", eps=1.0, min_pts=2, min_cluster_size=2, id_col="id", dims=2)
    assert out.select("cluster").distinct().count() == 1 and out.count() == 600
    nodes = spark.createDataFrame([(i,) for i in range(40)], "v long")
    pairs = [(i, i + 1) for i in range(40 - 1) if i != 19]
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "v long, u long")
    got = {r["v"]: r["c"] for r in label_components(nodes, edges, "v", "u").collect()}
    assert got == {i: 0 if i < 20 else 20 for i in range(40)}


def test_topics_are_reduced_to_the_number_asked_for(spark):
    from topicflow.operators import models as M
    words = {0: "a a a b b c", 1: "a a b b c c", 2: "x x y y z", 3: "p q r", 4: "x y"}
    counts = [(t, w, 1) for t, ws in words.items() for w in ws.split()]
    counts = spark.createDataFrame(counts, "topic long, term string, one int").groupBy("topic", "term").count().withColumnRenamed("count", "n")
    sizes = spark.createDataFrame([(0, 50), (1, 9), (2, 40), (3, 30), (4, 5)], "topic long, size long")
    got = {r["topic"]: r["new_topic"] for r in M.reduce_topics(counts, sizes, 3).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 2}


def _merged_one_by_one(counts, sizes, nr):
    """Every weight anew after each merge."""
    import math
    counts, sizes = {t: dict(c) for t, c in counts.items()}, dict(sizes)
    now = {t: t for t in sizes}
    while len(sizes) > nr:
        mean = sum(sum(c.values()) for c in counts.values()) // len(counts)
        f = {}
        for c in counts.values():
            for w, n in c.items():
                f[w] = f.get(w, 0) + n
        weight = {t: {w: n / sum(c.values()) * math.log(1 + mean / f[w]) for w, n in c.items()} for t, c in counts.items()}
        dot = lambda a, b: sum(x * weight[b].get(w, 0) for w, x in weight[a].items())
        least = min(sizes, key=lambda t: (sizes[t], t))
        target = min((t for t in counts if t != least), key=lambda t: (-round(dot(least, t) / math.sqrt(dot(least, least) * dot(t, t)), 12), t))
        for w, n in counts.pop(least).items():
            counts[target][w] = counts[target].get(w, 0) + n
        sizes[target] += sizes.pop(least)
        now = {t: target if x == least else x for t, x in now.items()}
    return now


def test_merge_tree_is_the_loop_at_every_count(spark):
    import random
    from collections import Counter

    from topicflow.operators import models as M
    r = random.Random(4)
    counts = {t: Counter(f"w{int(r.triangular(0, 40, (t * 7) % 40))}" for _ in range(r.randint(5, 200))) for t in range(3, 17)}
    sizes = {t: r.randint(1, 12) for t in counts}
    c = spark.createDataFrame([(t, w, n) for t, x in counts.items() for w, n in x.items()], "topic long, term string, n long").repartition(5)
    z = spark.createDataFrame(list(sizes.items()), "topic long, size long")
    tree = M.merge_tree(c, z)
    assert M.merge_tree(c, z, cells=400) == tree                    # in several passes
    for nr in range(1, 16):
        got = {x["topic"]: x["new_topic"] for x in M.cut_tree(tree, z, nr).collect()}
        assert got == _merged_one_by_one(counts, sizes, nr) and len(set(got.values())) == min(nr, len(sizes))
    empty = M.merge_tree(c, z.union(spark.createDataFrame([(99, 0)], "topic long, size long")), 14)
    assert empty == [(99, 3)]                                       # a topic without words joins the first
    assert M.merge_tree(c.limit(0), z.limit(0)) == []


def test_grid_goes_on_where_it_stopped(spark, tmpdir_path, monkeypatch):
    from topicflow.plans import trainer
    corpus = spark.createDataFrame([(i, ["a", "b", "c", "d"][i % 3:]) for i in range(12)], "doc_id long, tokens array<string>")
    ran = []

    def fit(corpus, params):
        ran.append(params["num_topics"])
        if params["num_topics"] == stop:
            raise RuntimeError("stopped")
        return spark.createDataFrame([(0, 0, "a", 1.0), (0, 1, "b", 0.5)], "topic long, rank long, term string, weight double")

    monkeypatch.setitem(trainer.TRAINERS, "Planted", fit)
    monkeypatch.setattr(trainer.Q, "score_summary", lambda corpus, topics, **_: topics.agg(F.count(F.lit(1)).alias("cv")))
    path, grid, stop = tmpdir_path + "/runs", {"num_topics": [2, 3, 4, 5], "note": "x"}, 4
    with pytest.raises(RuntimeError):
        trainer.train(corpus, "Planted", grid, save=path, resume=True)
    kept = {r["Topic Numbers"] for r in trainer.read_records(spark, path).collect()}
    assert {2, 3} <= kept and 4 not in kept
    stop, ran[:] = None, []
    got = trainer.train(corpus, "Planted", grid, save=path, resume=True, parallel=2).collect()
    assert sorted(ran) == sorted({2, 3, 4, 5} - kept)
    assert [r["Topic Numbers"] for r in got] == [2, 3, 4, 5] and trainer.read_records(spark, path).count() == 4
    again = trainer.train(corpus, "Planted", grid, parallel=3).collect()
    strip = lambda rows: [{k: v for k, v in r.asDict().items() if k != "Computation Time"} for r in rows]
    assert strip(again) == strip(got)


def test_phrase_repeat_by_line_is_the_whole_pattern(spark):
    import random
    from pyspark.sql import functions as F
    from topicflow.functions.text import t12_phrase_repeat
    r = random.Random(1)
    rows = [("".join(r.choice("ab \n") for _ in range(r.randint(0, 30))),) for _ in range(3000)] + [(None,), ("",), ("\n\n\n",), ("banana\nbanana",)]
    df = spark.createDataFrame(rows, "s string").select("s", t12_phrase_repeat("s").alias("a"), F.regexp_replace("s", r"(?d)(.{2,}?)\1+", "$1").alias("b"))
    assert df.where("not (a <=> b)").count() == 0


def test_preparation_with_every_stage_and_sampling(spark):
    from topicflow.plans import preprocess as P
    text = "The quick brown foxes were running over the very lazy dogs and the other animals in this garden"
    docs = spark.createDataFrame([(i, text if i % 2 else "Der Hund und die Katze sind nicht in dem Haus") for i in range(8)] + [(9, None)], "doc_id long, text string")
    lex = spark.createDataFrame([("over", "IN", "ADP", "over"), ("foxes", "NNS", "NOUN", "fox"), ("very", "RB", "ADV", "very"), ("garden", "NN", "X", "garden")],
                                "term string, pos string, upos string, lemma string")
    out = P.preprocess(docs, skip=("t5", "t12"), stop=("the", "and", "in", "this"), nouns=lex, lemmas=lex).collect()
    assert sorted(r["source_index"] for r in out) == [1, 3, 5, 7]
    assert all("fox" in r["tokens"] and not {"over", "very", "garden", "the"} & set(r["tokens"]) and "lazy" in r["tokens"] for r in out)
    drawn = P.preprocess(docs, samp_size=20, skip=("t5", "t12")).collect()
    assert len({r["doc_id"] for r in drawn}) == len(drawn) and {r["source_index"] for r in drawn} <= {1, 3, 5, 7}


def test_dataset_round_trip_of_a_prepared_corpus(spark, tmpdir_path):
    from topicflow.plans import preprocess as P
    from topicflow.sources.corpus import load_dataset
    docs = spark.createDataFrame([(i, f"word alpha beta gamma{'x' * i} delta") for i in range(5)], "doc_id long, text string")
    prep = docs.selectExpr("doc_id", "split(text, ' ') AS tokens")
    kept = P.tokenised_dataset(prep, tmpdir_path + "/ds", min_df=0.3, max_df=1.0)
    back = load_dataset(spark, tmpdir_path + "/ds")
    assert back["corpus"].count() == kept.count() == 5
    terms = {r["term"] for r in back["vocabulary"].collect()}
    assert not any(t.startswith("gamma") and len(t) > 5 for t in terms)


def test_ids_are_validated(spark):
    import pytest
    from topicflow.operators.filters import require_valid_ids
    good = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert require_valid_ids(good) is good
    for rows, schema in (([(1, "a"), (1, "b")], "doc_id long, text string"), ([(None, "a")], "doc_id long, text string"),
                         ([(1, None)], "doc_id long, text string"), ([(1.5, "a")], "doc_id double, text string"), ([(1, 2)], "doc_id long, text long")):
        with pytest.raises(ValueError):
            require_valid_ids(spark.createDataFrame(rows, schema))


def test_stop_word_lists_need_no_jar():
    import pytest
    from topicflow.functions import stopwords
    assert len(stopwords.stopwords("en")) > 150 and stopwords.stopwords("ca") == ()
    with pytest.raises(KeyError):
        stopwords.union(("en", "ca"))
    assert "amb" in stopwords.union(("ca",), {"ca": ("amb",)})


def test_vector_topics_and_topic_files(spark, tmpdir_path):
    import os
    from topicflow.plans import pipelines, trainer
    axes = {"cat": [1.0, 0.0, 0.1], "dog": [0.9, 0.1, 0.1], "car": [0.0, 1.0, 0.1], "bus": [0.1, 0.9, 0.1]}
    words = spark.createDataFrame(list(axes.items()), "term string, vec array<double>")
    docs = [(i, ["cat", "dog", "cat"] if i % 3 else ["car", "bus", "bus"]) for i in range(30)]
    corpus = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    jitter = [1 + i / 300 for i in range(30)]
    vecs = spark.createDataFrame([(i, [sum(axes[t][k] for t in toks) * jitter[i] + 0.01 * ((i * 7 + k) % 5) for k in range(3)] + [0.0, 0.01 * (i % 2), 0.01]) for i, toks in docs],
                                 "doc_id long, doc_vec array<double>")
    wide = words.selectExpr("term", "concat(vec, array(0.0D, 0.0D, 0.0D)) AS vec")
    got = pipelines.vector_topics(corpus, n_clusters=2, min_topic_size=2, doc_vectors=vecs, word_vectors=wide, k=2).collect()
    first = {r["term"] for r in got if r["topic"] == 0}
    assert first == {"cat", "dog"} and {r["term"] for r in got if r["topic"] == 1} == {"car", "bus"}
    os.makedirs(tmpdir_path + "/t")
    with open(tmpdir_path + "/t/x_animals_topk2.txt", "w") as f:
        f.write("cat dog\ncar bus\n")
    runs = trainer.train(corpus, "TopicFile", {"path": tmpdir_path + "/t", "num_topics": 2}).first()
    assert runs["Topic Numbers"] == 2 and abs(runs["Scores"]["diversity"] - 4 / 20) < 1e-9


def test_word2vec_query_returns_the_vectors(spark):
    from topicflow.plans import registry
    registry.load_all()
    rows = registry.QUERIES["m19_word2vec"](spark, "/root/testdata/sf0.001").collect()
    docs = {}
    for r in rows:
        docs.setdefault(r["doc_id"], {})[r["dim"]] = r["value"]
    assert all(sorted(v) == list(range(50)) for v in docs.values())
    assert sum(any(v.values()) for v in docs.values()) > 0.9 * len(docs) > 100
    assert len({tuple(v.values()) for v in docs.values()}) > 0.5 * len(docs)


def test_full_pipelines_run_every_stage(spark):
    from topicflow.plans import q_prep, registry
    registry.load_all()
    sf = "/root/testdata/sf0.001"
    stages = q_prep._stages(spark, sf)
    lex = {r["term"]: r for r in stages["nouns"].collect()}
    pairs = {f"{r['a']}_{r['b']}" for r in stages["phrases"].collect()}
    full = {r["doc_id"]: r["tokens"].split(" ") for r in registry.QUERIES["k13_word_pipeline_full"](spark, sf).collect()}
    plain = {r["doc_id"]: r["tokens"].split(" ") for r in registry.QUERIES["k13_word_pipeline"](spark, sf).collect()}
    seen = [t for ts in full.values() for t in ts]
    assert 0 < len(seen) < sum(map(len, plain.values())) and full.keys() <= plain.keys()
    joined = {t for t in seen if "_" in t}
    assert joined and joined <= pairs
    lemmas = {r["lemma"] for r in lex.values()}                # typo correction leads to any dictionary word
    assert all(t in lemmas for t in seen if "_" not in t)
    k14 = registry.QUERIES["k14_corpus_pipeline_full"](spark, sf).collect()
    assert k14 and all(r["tokens"].split(" ") == full[r["doc_id"]] and r["source_index"] == r["doc_id"] for r in k14)


def test_dense_index_holds_for_every_column_of_wide_rows(spark):
    """The counts must not come from another partitioning than the rows (bounds are drawn, partitions merged by size)."""
    from pyspark.sql import functions as F
    rows = spark.range(20000).repartition(7).withColumn(
        "pad", F.expr("array_join(transform(sequence(1, 40), i -> sha2(concat(id, ':', i), 256)), '')"))
    got = filters.dense_index(rows.orderBy("id"), "at").where("at <> id or at is null").count()
    numbered = filters.dense_index(rows.orderBy("id"), "at").agg(F.count_distinct("at").alias("n"), F.max("at").alias("m"), F.min(F.length("pad")).alias("p")).first()
    assert got == 0 and (numbered["n"], numbered["m"]) == (20000, 19999)


def test_repeated_phrases_of_any_length_like_the_pattern():
    import random
    import re
    from topicflow.functions.repeats import collapse
    r = random.Random(5)

    def text(letters, n):
        return "".join(r.choice(letters) for _ in range(n))
    made = []
    for letters in ("a", "ab", "ab\n", "abcdé𝔸 ", "abcdefghijklmnopqrstuvwxyz "):
        for _ in range(150):
            made.append(text(letters, r.randint(0, 30)) + text(letters, r.randint(1, 90)) * r.randint(1, 4) + text(letters, r.randint(0, 9)))
    expect = [re.sub(r"(.{2,}?)\1+", r"\1", t) for t in made]
    assert list(collapse(made)) == expect and list(collapse([None, "", "banana", None])) == [None, "", "bana", None]


def test_repeated_phrase_of_a_long_line_in_time(spark):
    import time
    from topicflow.functions.text import t12_phrase_repeat
    line = "".join(f"{i:x} " for i in range(1, 12000))           # one line without a long repetition
    df = spark.createDataFrame([(line + str(i),) for i in range(8)], "s string").select(t12_phrase_repeat("s").alias("s"))
    begun = time.time()
    assert df.where("length(s) > 10000").count() == 8
    assert time.time() - begun < 20


def test_restricted_tokens_stay_in_the_document_layout(spark):
    """V4 of rows that lie by document: the tokens are not shuffled, by a lower bound or without one."""
    from topicflow.operators import vocab
    rows = [(i, "en", ["every", "rare" + str(i), "half"] if i % 2 else ["every", "rare" + str(i)]) for i in range(40)]
    df = spark.createDataFrame(rows + [(None, "en", ["half"]), (50, None, None)], "doc_id long, lang string, tokens array<string>").repartition("doc_id")
    for low, high, expect in ((0.0, 0.9, {"half", "rare"}), (0.1, 0.9, {"half"}), (0.1, 1.0, {"every", "half"})):
        out = vocab.restrict_by_df_bounds(df, low, high, keep=("lang",))
        assert {t.rstrip("0123456789") for r in out.collect() for t in r["tokens"]} == expect
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        moves = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x]
        assert moves and all("REPARTITION_BY_COL" in x for x in moves)


def test_cluster_topics_find_their_vectors_and_counts_once(spark):
    """The fits and the merges read documents and tokens that were found once."""
    from topicflow.plans import pipelines
    vectors, words = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def vec(i):
        vectors.add(1)
        return [float(i % 4 == k) + i / 1000 for k in range(6)]

    @F.udf("array<string>")
    def toks(i):
        words.add(1)
        return [f"w{i % 4}", f"w{i % 4}", "all", f"x{i % 8}"]

    docs = spark.range(60).withColumnRenamed("id", "doc_id").repartition(2)
    got = pipelines.cluster_topics(docs.select("doc_id", toks("doc_id").alias("tokens")), nr_topics=2, n_clusters=4, min_topic_size=2,
                                   doc_vectors=docs.select("doc_id", vec("doc_id").alias("doc_vec")), k=3).collect()
    assert len({r["topic"] for r in got}) == 2
    assert (vectors.value, words.value) == (60, 60)
