"""Readers and writers on generated files in fresh temp folders."""

import json
import os

from pyspark.sql import functions as F

from topicflow.operators import results as R
from topicflow.sources import corpus as S
from topicflow.sources import results as RS


def _write(path, obj):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(obj if isinstance(obj, str) else json.dumps(obj))


def test_results_tree(spark, tmpdir_path):
    root = tmpdir_path
    rec = lambda m, k, npmi: {"Dataset": "d1", "Model": m, "Params": {"nr_topics": k}, "Dataset Size": 10,
                              "Computation Time": 1.5, "Scores": {"npmi": npmi, "diversity": 0.5}}
    _write(f"{root}/Basic/d1/a.json", [rec("LDA", 10, 0.1), rec("LDA", 20, 0.3)])
    _write(f"{root}/Basic/d1/b.json", [{**rec("BERTopic", 0, 0.2), "Params": {"nr_topics": 0, "num_topics": 30},
                                        "Score Summary": {"npmi": 0.2, "diversity": 0.9}, "Scores": None}])
    _write(f"{root}/Basic/d1/metadata.json", [rec("X", 1, 9.9)])
    _write(f"{root}/Dynamic Topic Modeling/d1/BERTopic1.json",
           [{"Dataset": "d1", "Model": "BERTopic", "Params": {"nr_topics": 5}, "Dataset Size": 10,
             "Computation Time": 2.0, "Scores": {"0": {"npmi": 0.1, "diversity": 0.8}, "1": {"npmi": 0.2, "diversity": 0.7}}}])
    _write(f"{root}/Computation/lda.csv", "vocab_size,time\n2500,1.0\n5000,2.5\n")
    _write(f"{root}/Computation/bertopic.csv", "vocab_size,time\n2500,3.0\n")
    fr = RS.load_results(spark, root)
    basic = R.flatten(fr["basic"]).collect()
    assert len(basic) == 3
    labels = sorted((r["Model"], r["nr_topics"]) for r in basic)
    assert labels == [("BERTopic_1", 30), ("LDA_0", 10), ("LDA_0", 20)]
    assert {r["npmi"] for r in basic if r["Model"] == "BERTopic_1"} == {0.2}
    dtm = R.flatten(fr["dtm"], combine_models=True).collect()
    assert sorted((r["Model"], r["time_slice"], r["npmi"]) for r in dtm) == [("BERTopic", "0", 0.1), ("BERTopic", "1", 0.2)]
    comp = R.cost_series(fr["computation"]).collect()
    assert sorted((r["model"], r["family"], r["vocab_size"]) for r in comp)[0] == ("bertopic.csv", "BERTopic", 2500.0)
    keys = sorted(tuple(r) for r in RS.result_keys(fr).collect())
    assert keys == [("basic", "d1"), ("dtm", "d1")]


def test_run_record_sink_roundtrip(spark, tmpdir_path):
    df = spark.createDataFrame([("d", 5, "LDA", 10, {"num_topics": "10"}, 1.0, {"npmi": 0.1, "diversity": 0.9}, None)],
                               RS.BASIC_SCHEMA)
    RS.write_run_records(df, f"{tmpdir_path}/runs")
    RS.write_run_records(df, f"{tmpdir_path}/runs")
    assert RS.read_run_records(spark, f"{tmpdir_path}/runs").count() == 2


def test_topic_files(spark, tmpdir_path):
    _write(f"{tmpdir_path}/t/run_answer_topk20.txt", "w1 w2 w3\nv1 v2\n")
    _write(f"{tmpdir_path}/t/x_20newgroups_topk30.txt", " ".join(f"z{i}" for i in range(20)) + "\n")
    df = RS.read_topic_files(spark, f"{tmpdir_path}/t")
    rows = df.groupBy("dataset", "num_topics", "topic").agg(F.count(F.lit(1)).alias("n")).collect()
    got = sorted(tuple(r) for r in rows)
    assert got == [("20NewsGroup", "30", 0, 15), ("yahoo_answer", "20", 0, 3), ("yahoo_answer", "20", 1, 2)]


def test_csv_corpus_and_lines(spark, tmpdir_path):
    _write(f"{tmpdir_path}/c/train.csv", '1,x,"Hello\nWorld"\n2,y,ok\n3,z,"A, B"\n')
    df = S.read_csv_corpus(spark, f"{tmpdir_path}/c/train.csv", 2)
    assert sorted(r["text"] for r in df.collect()) == ["A, B", "Hello\nWorld", "ok"]
    S.write_lines(df, f"{tmpdir_path}/lines")
    back = S.read_lines(spark, f"{tmpdir_path}/lines")
    assert sorted(r["text"] for r in back.collect()) == ["A, B", "Hello World", "ok"]


def test_dataset_save_load(spark, tmpdir_path):
    corpus = spark.createDataFrame([(5, ["a", "b"]), (9, ["b"])], "doc_id long, tokens array<string>")
    vocab = spark.createDataFrame([("a",), ("b",)], "term string")
    S.save_dataset(corpus, vocab, 3, f"{tmpdir_path}/ds")
    ds = S.load_dataset(spark, f"{tmpdir_path}/ds")
    assert sorted((r["doc_id"], r["doc_index"]) for r in ds["corpus"].collect()) == [(5, 0), (9, 1)]
    meta = {r["key"]: r["value"] for r in ds["metadata"].collect()}
    assert meta["total_documents"] == "3" and meta["vocabulary_length"] == "2"
