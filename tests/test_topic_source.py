"""Topic files through the data source: rows, numbers, and which files are read."""

import os

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from topicflow.sources import topic_source as TS
from topicflow.sources.results import read_topic_files

FILES = {"ntm_answer_topk10.txt": "a b c\nd e\n\nf g h i\n", "ntm_20newgroups_topk10.txt": "x y\r\nz é\n",
         "ntm_answer_topk50.txt": " ".join(f"w{i}" for i in range(40)) + "\n", "notes.txt": "no topics\n", "m_answer_topk20.csv": "q\n"}


def folder(tmpdir_path, files=FILES):
    path = f"{tmpdir_path}/topics"
    os.makedirs(path, exist_ok=True)
    for name, text in files.items():
        with open(f"{path}/{name}", "w", encoding="utf-8", newline="") as f:
            f.write(text)
    return path


def test_rows_and_numbers(spark, tmpdir_path):
    TS.register(spark)
    df = spark.read.format("topic_files").load(folder(tmpdir_path))
    got = {(r["file"], r["topic"], r["rank"]): r["term"] for r in df.collect()}
    want = {}
    for name, text in FILES.items():
        if name.startswith("ntm"):
            for t, line in enumerate(text.split("\n")):
                for k, w in enumerate(line.split()[:15]):
                    want[name, t, k] = w
    assert got == want
    assert {(r["dataset"], r["num_topics"]) for r in df.select("dataset", "num_topics").distinct().collect()} == {
        ("yahoo_answer", "10"), ("20NewsGroup", "10"), ("yahoo_answer", "50")}
    assert spark.read.format("topic_files").option("max_words", 2).load(folder(tmpdir_path)).where("rank > 1").count() == 0


def test_agrees_with_the_text_reader(spark, tmpdir_path):
    TS.register(spark)
    path = folder(tmpdir_path, {k: v for k, v in FILES.items() if k in ("ntm_answer_topk50.txt",)} | {"a_b_topk3.txt": "p q r\ns t\n"})
    cols = ["dataset", "num_topics", "file", "topic", "rank", "term"]
    new = spark.read.format("topic_files").load(path).select(*cols)
    old = read_topic_files(spark, path).select(*cols)
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, old.collect()))


def test_only_files_asked_for_are_partitions(spark, tmpdir_path):
    TS.register(spark)
    path = folder(tmpdir_path)
    df = spark.read.format("topic_files").load(path)
    assert df.rdd.getNumPartitions() == 3
    one = df.where((F.col("dataset") == "yahoo_answer") & F.col("num_topics").isin("50", "99"))
    assert one.rdd.getNumPartitions() == 1 and one.count() == 15
    assert df.where(F.col("rank") == 1).select("term").count() == 6           # a filter the reader leaves to Spark
    assert df.where(F.col("dataset") == "none").count() == 0

    reader = TS.TopicFileReader({"path": path})
    rest = list(reader.pushFilters([EqualTo(("dataset",), "yahoo_answer"), GreaterThan(("rank",), 1), In(("num_topics",), ("10", "50")), EqualTo(("num_topics",), "10")]))
    assert rest == [GreaterThan(("rank",), 1)]
    assert [p.path.rsplit("/", 1)[-1] for p in reader.partitions()] == ["ntm_answer_topk10.txt"]


def test_empty_folder(spark, tmpdir_path):
    TS.register(spark)
    assert spark.read.format("topic_files").load(folder(tmpdir_path, {})).count() == 0
