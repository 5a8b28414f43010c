"""Registered queries against their DuckDB oracle on the smallest folder."""

import os

import pytest

from tests.oracle_harness import compare, duck

DATA = "/root/testdata/sf0.001"
FAST = ["flagship_lang_topics", "p1_min_length", "p4_exact_sample", "t16_chain_without_backrefs", "t4_step",
        "t17_language_vote", "t17_language_profiles", "t17_profiles_against_vote", "k10_simple_tokenize", "k11_markup_tokenize", "v1_vocab_df_bounded", "v8_tfidf",
        "m11_top_words_source", "q_npmi_source", "q_cv_source", "q_ca_source", "q_cp_benchmark",
        "a7_comparison_table", "a9_top_three", "m15_nearest_topic", "o3_topics_over_time", "o1_time_bins_events",
        "k7_collocations", "k8_apply_collocations", "k9_lemmatise"]


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver test data absent")
@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, DATA, con)
    assert r["ok"], r


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver test data absent")
def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.queries()) >= set(E.oracle_sql())
