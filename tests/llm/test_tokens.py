"""Token files read back, and the length histogram, against direct computation."""

import zlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from topicflow.llm import bpe, token_counts, tokens_out

TEXTS = ["Hello WORLD it's", "", None, "ÀÉ  naïve\n\nline two", "<|endoftext|> a", "tab\there 123 !!", "x" * 300, "日本 🙂", "é ̈a", " nb sp"]

ENCODER = tokens_out.Encoder(tokens_out.Params())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50_000), st.integers(0, 2 ** 32 - 1)), max_size=100), st.sampled_from([8, 16, 64]),
       st.sampled_from([0.0, 0.5, 0.9, 1.0]))
def test_round_trip_of_blocks(ids, block, q):
    p = tokens_out.Params(block=block, percentile=q)
    x = np.array(ids, np.uint32)
    assert tokens_out.unpack(tokens_out.pack(x, p), p)[:len(x)].tolist() == ids
    half = len(ids) // 2
    r = tokens_out.Reader(tokens_out.shard([5, None], [x[:half], x[half:]], p))
    assert r.ids().tolist() == ids and r.lens.tolist() == [half, len(ids) - half] and r.nulls.tolist() == [False, True]
    if len(r.starts) > 2:
        assert r.blocks(1, 2).tolist() == ids[block:2 * block]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aBcDéÀ'’.,-_<| \n\tıİΣσ日本1²\u0301\u0338\xa0"), st.characters(exclude_categories=["Cs"])), max_size=25), max_size=6))
def test_encoder_against_the_library(texts):
    e = ENCODER
    e.known.size = 8
    for t in texts + texts[::-1]:
        assert e([t])[0].tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 2]


def test_memo_keeps_what_is_used():
    e = tokens_out.Encoder(tokens_out.Params(memo=40))
    calls, encode = [], e.known.encode
    e.known.encode = lambda x: calls.append(x) or encode(x)
    for i in range(200):
        e([f"often again new{i}x"])
        assert len(e.known) + len(e.known.old) < 60
    assert calls.count("often") == 1 and calls.count("again") == 1 and len(calls) > 200


def test_other_tokenizers_get_whole_pieces(tmp_path):
    from tokenizers import models, pre_tokenizers
    t = Tokenizer(models.WordLevel({"Ab.": 0, "ab": 1, "?": 2}, unk_token="?"))
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    t.save(str(tmp_path / "t.json"))
    e = tokens_out.Encoder(tokens_out.Params(tokenizer=str(tmp_path / "t.json")))
    assert not e.folds and e(["Ab. ab Ab\n."])[0].tolist() == [0, 1, 2, 2, 2]


def test_files(spark):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(100 - i, x) for i, x in enumerate(TEXTS * 4)] + [(None, "null id"), (3, "last one"), (3, "last one")]
    docs = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "doc_id long, text string, start int, part int")
    got = [tuple(r) for r in tokens_out.token_files(docs, tokens_out.Params(shard_ids=30, block=16, memo=5)).collect()]
    want, start = [], 0
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert tokens_out.token_files(docs.limit(0)).count() == 0


def test_length_histogram(spark):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load("byte_bpe_50k.tiktoken").ranks, special_tokens={})
    rows = [(i, (x or "") * (i % 7) if i % 5 else x) for i, x in enumerate(TEXTS * 6)] + [(None, None), (1, "word " * 30_000)]
    docs = spark.createDataFrame([(i, x, 1) for i, x in rows], "doc_id long, text string, length int")
    lens = sorted(len(enc.encode_ordinary(x or "")) for _, x in rows)
    table = token_counts.token_counts(docs, token_counts.Params(bucket=8)).cache()
    got = {r["length"]: r for r in table.collect()}
    assert set(got) == set(lens)
    for n, r in got.items():
        within = [x for x in lens if x <= n]
        assert (r["n_docs"], r["docs_within"], r["tokens_within"]) == (lens.count(n), len(within), sum(within))
        assert r["truncated_total"] == sum(min(x, n) for x in lens)
        assert (r["docs_over"], r["tokens_over"]) == (len(lens) - len(within), sum(lens) - sum(within))
    for limit in (0, 1, 2, 50, 10 ** 6):
        r = token_counts.at_limit(table, limit).first()
        assert r["truncated_total"] == sum(min(x, limit) for x in lens) and r["docs_within"] == sum(x <= limit for x in lens)
    assert token_counts.quantile(table, 0.5).first()["length"] == lens[(len(lens) - 1) // 2]
    assert token_counts.token_counts(docs.limit(0)).count() == 0
    assert table.agg(F.sum("n_docs")).first()[0] == len(rows)


def test_a_text_of_one_word_is_counted_beside_texts_that_begin_with_it():
    count = token_counts.Counter(token_counts.Params())
    texts = ["word", "word and more", None, "word", "a word", "more"]
    plain = [len(count.encoding.encode_ordinary(t or "")) for t in texts]
    assert count(texts) == plain and count(texts[::-1]) == plain[::-1]
