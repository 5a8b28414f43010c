"""Encoding against the tiktoken library, decoding against the text itself."""

import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from topicflow.llm import bpe

ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "\n", " \n x", "a\nb c\n\n d", "don't we'll I'd", "aaa aaaa aaaaa aaaaaaaaa", "x y", "　z  ",
       "1234 56", "ñandú über naïve", "日本語 テスト", "🙂🙂 ok", "\x1c\x1fq", "́ a", "ab" * 500, "!!!???...", "\t\tx", "a \t b", "\r\n r", "zzz\x00zzz"]


def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load(bpe.Params().ranks).ranks, special_tokens={})


def ids_of(texts, **kw):
    e = bpe.Encoder(bpe.Params(**kw))
    out = e.encode(texts)
    for t, x in zip(texts, out):
        assert e.decode(x) == (t or "").encode()
    return [np.frombuffer(x, "<u4").tolist() for x in out]


def test_odd_texts():
    enc = reference()
    assert ids_of([None, *ODD]) == [[], *[enc.encode_ordinary(t) for t in ODD]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'.,aabé1ñstre"), st.characters(blacklist_categories=("Cs",))), max_size=60), max_size=6))
def test_any_text(texts):
    enc = reference()
    assert ids_of(texts) == [enc.encode_ordinary(t) for t in texts]


def test_every_letter_and_number_class():
    enc = reference()
    chars = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}1 {c}{c}b" for c in chars]
    ours = ids_of(texts)
    theirs = [enc.encode_ordinary(t) for t in texts]
    assert [c for c, a, b in zip(chars, ours, theirs) if a != b] == []


def test_single_word_merges():
    v = bpe.load(bpe.Params().ranks)
    words = [w.encode() for w in ("tion", "entertainment", "aaaaaaaaaaa", "ththth", "ñññññ", "abababababab")]
    packed = bpe.PairIndex(v, words).encoded()
    whole = [[v.ranks[w]] if w in v.ranks else v.one(w) for w in words]
    assert [np.frombuffer(x, "<u4").tolist() for x in packed] == whole


def test_query_rows(spark):
    rows = [(1, "Hello  wörld\nagain"), (2, None), (2, ""), (None, "x"), (3, "ab " * 40_000), (1, "Hello  wörld\nagain")]
    docs = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, ids int, n_tokens string")
    enc = reference()
    want = []
    for i, t in rows:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in bpe.digests(docs, bpe.Params(block_chars=50, memo=3)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe.digests(docs.limit(0)).count() == 0
