"""Parts and rules against plain string code, Viterbi against all splits, and planted names."""

import itertools
import math
import random
import time
from collections import Counter

from topicflow.llm import url_filter as U

SCHEMA = "page_id long, url string, html string, host string, score int"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    e = min([rest.index(c, k) for c in "?#" if c in rest[k:]], default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k]), rest[k:e]


def plain_rule(host, path):
    fits = [r for r in U.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return (best[0] + best[1], best[2]) if best else (None, None)


URLS = ["http://A.Example.ORG/es/1?x=/y#z", "https://example.org/en/12", "https://x.example.org/en/2", "http://notexample.org/es/", "http://org/", "http://org",
        "ftp://a.com/de/", "http://a.com/de", "http://COM/fr/x", "x://y://z/fr/", "nothing", "", None, "http://É.com/fr/", "http://?q", "http://h#f", "://", "http://a.b\nc.org/x\n/y"]


def corpus():
    r = random.Random(1)
    words = ["river", "garden", "cloud", "stone", "paper", "silver", "forest", "window"]
    rows = []
    for i in range(400):
        a, b = r.sample(words, 2)
        name = r.choice([a + b, a + "-" + b, a])
        if i % 9 == 0:
            name = r.choice(["casino", "free-bets", "poker" + a, "adult" + b, "spam-" + a, "cheapcasino"])
        rows.append((i, f"https://www.{name}.example.net/en/{i}", f"<title>{a} {b} cheap free offers</title>", "h", 1))
    return rows + [(1000 + i, u, None, "h", 1) for i, u in enumerate(URLS)] + [(1000, URLS[0], None, "h", 1), (None, URLS[1], "", None, None)]


def test_rows(spark):
    rows = corpus()
    got = U.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    url = {r[0]: r[1] for r in rows}
    for g in got:
        host, path = plain_parts(url[g["page_id"]])
        rule, verdict = plain_rule(host, path)
        assert (g["host"], g["path"], g["rule"]) == (host, path, rule)
        assert g["verdict"] == verdict if rule else g["verdict"] in ("allow", "block")
    block = {g["page_id"] for g in got if g["verdict"] == "block"}
    assert set(range(0, 400, 9)) <= block
    assert not block & {i for i in range(400) if i % 9}


def test_viterbi_is_the_best_split():
    r = random.Random(2)
    for _ in range(60):
        name = "".join(r.choice("abc") for _ in range(r.randint(1, 8)))
        counts = {(i, j): r.randint(1, 50) for i in range(len(name)) for j in range(i + 1, len(name) + 1) if r.random() < 0.5}
        cost = lambda i, j: math.log(counts[i, j] / 999) if (i, j) in counts else math.log(1 / 999) - (j - i) * math.log(10)
        best = max(sum(cost(i, j) for i, j in zip((0, *c), (*c, len(name)))) for k in range(len(name)) for c in itertools.combinations(range(1, len(name)), k))
        got = U.viterbi(name, [(i, j, n) for (i, j), n in counts.items()], 999)
        cut = [0, *itertools.accumulate(map(len, got))]
        assert "".join(got) == name and abs(sum(cost(i, j) for i, j in zip(cut, cut[1:])) - best) < 1e-9


def test_segments(spark):
    found = spark.createDataFrame([("cheapcasino",), ("riverstone",), ("qqq",)], "name string")
    words = spark.createDataFrame([("cheap", 50), ("casino", 50), ("river", 9), ("stone", 9), ("che", 2), ("riverst", 1)], "word string, n long")
    got = {r["name"]: r["parts"] for r in U.segment(found, words, U.Params()).collect()}
    assert got == {"cheapcasino": ["cheap", "casino"], "riverstone": ["river", "stone"], "qqq": ["qqq"]}


def test_long_names_take_linear_time():
    name = "river" * 40_000
    hits = [(i, i + 5, 9) for i in range(0, len(name), 5)]
    start = time.monotonic()
    assert U.viterbi(name, hits, 999) == ["river"] * 40_000
    assert U.viterbi("q" * 200_000, [], 999) == ["q" * 200_000]
    assert time.monotonic() - start < 5


def test_words_of_any_valid_length(spark):
    long = "donaudampfschifffahrtsgesellschaft"
    words = spark.createDataFrame([(long, 9), ("casino", 50), ("donau", 50)], "word string, n long")
    got = U.segment(spark.createDataFrame([(long + "casino",)], "name string"), words, U.Params()).collect()
    assert got[0]["parts"] == [long, "casino"]


def test_words_beside_seeds_block_names_without_one(spark):
    """`mania` is no seed; only the split of `maniaworld` and the counts of the classifier can block it."""
    r = random.Random(5)
    words = ["river", "garden", "cloud", "stone", "paper", "silver", "forest", "window", "club"]
    rows = [(i, f"https://{r.choice(words)}{r.choice(words)}.example.net/en/{i}", f"<title>{' '.join(words)} mania world</title>") for i in range(200)]
    rows += [(200 + i, f"https://{r.choice(['casino', 'poker', 'bets'])}mania.example.net/en/{i}", None) for i in range(100)]
    rows += [(1000, "https://maniaworld.example.net/en/1", None), (1001, "https://riverclub.example.net/en/1", None)]
    got = {g["page_id"]: g["verdict"] for g in U.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1000] == "block" and got[1001] == "allow"
    assert all(got[i] == ("block" if i >= 200 else "allow") for i in range(300))


def test_scores_are_naive_bayes(spark):
    p, r = U.Params(), random.Random(6)
    rows = [(f"h{i}", f"/p{i}", r.randint(1, 9), [r.choice(["casino", "poker", "win", "river", "club"]) for _ in range(r.randint(0, 5))]) for i in range(60)]
    block = lambda t: bool(set(t) & set(p.seeds))
    docs = {k: sum(n for _, _, n, t in rows if block(t) == k) for k in (True, False)}
    count = {k: Counter() for k in docs}
    for _, _, n, t in rows:
        for x in t:
            count[block(t)][x] += n
    size = len(set(count[True]) | set(count[False])) + 1
    chance = lambda x, k: (count[k][x] + p.alpha) / (sum(count[k].values()) + p.alpha * size)
    prior = math.log((docs[True] + p.alpha) / (docs[False] + p.alpha))
    got = {g["host"]: g["score"] for g in U.bayes(spark.createDataFrame(rows, "host string, sig string, n long, tokens array<string>"), p).collect()}
    for h, _, _, t in rows:
        assert abs(got[h] - prior - sum(math.log(chance(x, True) / chance(x, False)) for x in t)) < 1e-9


def test_empty(spark):
    assert U.judge(spark.createDataFrame([], SCHEMA)).count() == 0
