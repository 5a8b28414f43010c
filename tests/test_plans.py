"""Physical-plan properties that matter at scale."""

import os

import pytest

DATA = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver test data absent")
def test_scan_prunes_columns_and_topk_is_partial(spark):
    from topicflow.plans import corpus as C
    from topicflow.operators import ctfidf
    raw = C.raw_corpus(spark, DATA)
    plan = _plan(raw)
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in plan
    assert "n_chars" not in plan
    w = ctfidf.class_tfidf(C.restricted_long(spark, DATA), ["source"])
    top = _plan(ctfidf.top_words(w, ["source"], 10))
    assert "WindowGroupLimit" in top and "Partial" in top


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver test data absent")
def test_tokeniser_not_pushed_below_repartition(spark):
    from topicflow.plans import corpus as C
    from topicflow.operators.vocab import explode_tokens
    plan = _plan(explode_tokens(C.raw_corpus(spark, DATA)))
    assert "Exchange RoundRobinPartitioning" in plan      # small input: its few splits are dealt to all cores
    scan_side = plan.split("Exchange RoundRobinPartitioning")[-1]
    assert "regexp_extract_all" not in scan_side


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver test data absent")
@pytest.mark.parametrize("name", ["a2_topic_count", "m5_hybrid_vector", "m6_l2_normalise", "k10_simple_tokenize", "k11_markup_tokenize"])
def test_narrow_queries_have_no_exchange(spark, name):
    from topicflow.plans import registry
    registry.load_all()
    assert "Exchange" not in _plan(registry.QUERIES[name](spark, DATA))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver test data absent")
def test_window_counts_stay_in_the_document_layout(spark):
    from topicflow.operators import coherence as Q
    corpus = spark.createDataFrame([(i, ["a", "b", "c", "a"]) for i in range(50)], "doc_id long, tokens array<string>")
    topics = spark.createDataFrame([(0, 0, "a"), (0, 1, "b")], "topic long, rank int, term string")
    occ = Q.topic_occurrences(corpus, topics).persist()
    occ.count()
    plan = _plan(Q.single_counts(occ, (), "sliding", 3))
    assert "hashpartitioning(doc_id" not in plan.split("InMemoryTableScan")[0]
