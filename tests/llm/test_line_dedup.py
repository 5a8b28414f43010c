"""Chunks, removals and rebuilt texts against a plain computation."""

import random
import re
import struct

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from topicflow.llm import line_dedup as L

SMALL = L.Params(min_chars=10)
SCHEMA = "doc_id long, text string, n_chars long, at int, a string, _id string, m double"


def signed(x):
    return x - 2 ** 64 if x >= 2 ** 63 else x


def plain_units(text, p):
    tokens = lambda s: [x for x in re.split(r"(?<=\s)(?=\S)|(?<=[\u3040-\u30ff\u4e00-\u9fff])(?=\S)", s) if x]
    out = []
    for s in re.split(r"(?<=\n)|(?<=[.!?\u2026] )|(?<=[\u3002\uFF01\uFF1F])", text):
        run, before = "", None
        for w in tokens(s) if len(s.encode()) >= p.long_bytes else []:
            run += w
            h = signed(xxh64_intdigest(w.strip(" \t\r\n").encode(), 42))
            seed = 42 if before is None else xxh64_intdigest(struct.pack("<q", before), 42)
            if signed(xxh64_intdigest(struct.pack("<q", h), seed)) % p.words == 0:
                out, run = [*out, run], ""
            before = h
        out.append(s if len(s.encode()) < p.long_bytes else run)
    return out


def plain_dedup(rows, p):
    """Every chunk by its words, and its later places."""
    tokens = lambda s: re.split(r"(?<=\s)(?=\S)|(?<=[\u3040-\u30ff\u4e00-\u9fff])(?=\S)", s)
    cut = {t: plain_units(t, p) for _, t in rows if t}
    first, keys = {}, {}
    for i, t in rows:
        if not t:
            continue
        u = [(k, x.strip(" \t\r\n")) for k, x in enumerate(cut[t]) if x.strip(" \t\r\n")]
        found = [(k, z, (x, y)) for (k, x), (z, y) in zip(u, u[1:])]
        found += [(k, k, (x,)) for k, x in u if len(tokens(x) if len(x.encode()) >= p.long_bytes else x.split(" ")) > p.long_words]
        keys[i, t] = found
        for k, _, key in found:
            first[key] = min(first.get(key, (True, 2 ** 70, 0)), (i is not None, i or 0, k))
    out = []
    for i, t in rows:
        gone = {x for k, z, key in keys.get((i, t), []) if first[key] != (i is not None, i or 0, k) for x in range(k, z + 1)}
        text, run = "", ""
        for k, x in enumerate([*cut.get(t, []), ""]):
            if k in gone:
                run += x
                continue
            text += (run if len(run.strip(" \t\r\n")) < p.min_chars else "") + x
            run = ""
        out.append((i, t if not t or text == t else text[:-1] if text.endswith("\n") else text))
    return out


def corpus(seed=1, n=80):
    r = random.Random(seed)
    word = lambda: r.choice(["alpha", "beta", "gamma", "delta", "eps", "zéta", "eta"]) + str(r.randrange(50))
    sentence = lambda: " ".join(word() for _ in range(r.randint(2, 7)))
    shared = [". ".join(sentence() for _ in range(r.randint(1, 12))) + "." for _ in range(8)]
    shared += ["\n".join(sentence() for _ in range(9)) for _ in range(3)]
    rows = []
    for i in range(n):
        lines = [r.choice([sentence(), ". ".join(sentence() for _ in range(r.randint(1, 6))) + ".", ""]) for _ in range(r.randint(0, 8))]
        for _ in range(r.randint(0, 2)):
            lines.insert(r.randint(0, len(lines)), r.choice(shared))
        rows.append((i * 7 % 101, "\n".join(lines)))
    return rows + [(500, rows[3][1]), (501, rows[3][1]), (600, None), (601, ""), (602, "\n"), (603, ". . . ")]


def extra_rows():
    r = random.Random(2)
    word = lambda: "w%d" % r.randrange(9999)
    line = " ".join(word() for _ in range(60))
    rows = corpus() + [(700 + i, f"{word()} {word()}\n\n{line}\n  \n{word()}! {line} {word()}") for i in range(5)]
    rows += [(None, line), (None, None), (800, "\u4e2d\u6587" * 80 + "\u3002" + "\u65e5\u672c" * 40), (801, "\u4e2d\u6587" * 80 + "\u3002" + "\u65e5\u672c" * 40)]
    return rows + [(900 + i, f"{word()}\x01. Marked text stands here. Another sentence of it.\n\x01 and a third? {word()}") for i in range(3)]


@pytest.mark.parametrize("p", [SMALL, L.Params()])
def test_against_plain(spark, p):
    rows = extra_rows()
    df = spark.createDataFrame([(i, t, len(t or ""), 1, "q", "k", 2.0) for i, t in rows], SCHEMA)
    out = L.line_dedup(df, p)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = out.collect()
    want = plain_dedup(rows, p)
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r["n_chars"] == len(r["text"] or "") and tuple(r)[3:] == (1, "q", "k", 2.0) for r in got)
    assert sum(a[1] != b[1] for a, b in zip(rows, want)) > 5


def test_bytes_decide_where_hashes_are_equal(spark, monkeypatch):
    rows = extra_rows()
    df = spark.createDataFrame([(i, t, len(t or ""), 1, "q", "k", 2.0) for i, t in rows], SCHEMA)
    monkeypatch.setattr(L, "_hash", lambda t: F.octet_length(t).cast("long") % 7)
    got = L.line_dedup(df, SMALL).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(plain_dedup(rows, SMALL), key=repr)


def test_text_is_shuffled_once(spark):
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in corpus()], "doc_id long, text string, n_chars long")
    out = L.line_dedup(df)
    plan = out._jdf.queryExecution().executedPlan()
    out.collect()
    final = plan.toString().split("Initial Plan")[0]
    assert len(re.findall(r"^\W*(?:\d+ )?Exchange hashpartitioning\(a#\d+L, b#\d+L", final, re.M)) <= 2, final      # text, places


def test_null_ids_repeats_long_and_empty(spark):
    text = "One sentence here. Another sentence there. A third one follows."
    rows = [(None, text), (1, text), (1, text), (2, "x" * 200_000), (3, "A b. C d. " * 30_000)]
    df = spark.createDataFrame([(i, t, len(t), 1, "q", "k", 2.0) for i, t in rows], SCHEMA)
    got = sorted(((r["doc_id"] or -1, len(r["text"])) for r in L.line_dedup(df).collect()))
    assert got[:4] == [(-1, len(text)), (1, 0), (1, 0), (2, 200_000)]
    again = spark.createDataFrame([(1, text, 3), (1, text, 3)], "doc_id long, text string, n_chars long")
    assert [r["text"] for r in L.line_dedup(again).collect()] == [text, text]
    assert L.line_dedup(df.limit(0)).count() == 0


def test_shared_passage_goes_whole(spark):
    r = random.Random(4)
    s = lambda: " ".join("w%d" % r.randrange(9999) for _ in range(8))
    passage = ". ".join(s() for _ in range(8)) + "."
    docs = [(i, f"{s()}. {s()}.\n{passage}\n{s()}. {s()}.") for i in range(20)] + [(99, f"{s()}. {s()}.\n{s()}.")]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in docs], "doc_id long, text string, n_chars long")
    got = {x["doc_id"]: x["text"] for x in L.line_dedup(df).collect()}
    assert got[0] == docs[0][1] and got[99] == docs[-1][1]
    rest = sum(len(w) for i in range(1, 20) for w in passage.split() if w in got[i])
    assert rest <= 0.2 * 19 * len(passage)
    assert all(t.split("\n")[0] in got[i] and t.split("\n")[2] in got[i] for i, t in docs[:20])


@pytest.mark.parametrize("kind", ["lines of 12", "lines of 10", "two lines", "inside a paragraph", "no stops", "questions", "exclamations", "chinese"])
def test_passage_goes_in_any_surroundings(spark, kind):
    r = random.Random(kind)
    s = lambda n=12: " ".join("w%d" % r.randrange(9999) for _ in range(n))
    han = lambda n: "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(n))
    passage = {"lines of 12": lambda: "\n".join(s() for _ in range(5)), "lines of 10": lambda: "\n".join(s(10) for _ in range(8)),
               "two lines": lambda: s() + "\n" + s(), "inside a paragraph": lambda: ". ".join(s() for _ in range(5)) + ".",
               "no stops": lambda: s(60), "questions": lambda: "? ".join(s() for _ in range(5)) + "?",
               "exclamations": lambda: "! ".join(s() for _ in range(5)) + "!",
               "chinese": lambda: "".join(han(20) + "\u3002" for _ in range(5))}[kind]()
    join = ". " if kind == "inside a paragraph" else "\n"
    own = [(f"{s()}{join}{s()}", f"{s()}{join}{s()}") for _ in range(10)]
    docs = [(i, join.join((a, passage, b))) for i, (a, b) in enumerate(own)]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in docs], "doc_id long, text string, n_chars long")
    got = {x["doc_id"]: x["text"] for x in L.line_dedup(df).collect()}
    assert got[0] == docs[0][1]
    for i, (a, b) in list(enumerate(own))[1:]:
        assert got[i].replace(" ", "").replace("\n", "") == (a + join + b).replace(" ", "").replace("\n", ""), (kind, got[i])
