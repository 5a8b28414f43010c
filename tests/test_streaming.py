import datetime as dt

from topicflow.streaming import corpus_stream as CS


def test_stream_corpus_sink(spark, tmpdir_path):
    src, out = f"{tmpdir_path}/in", f"{tmpdir_path}/out"
    rows = [(1, "The topic models of corpora", dt.datetime(2024, 1, 1)), (2, "ab", dt.datetime(2024, 1, 2))]
    spark.createDataFrame(rows, CS.DOC_SCHEMA).write.parquet(src)
    q = CS.start_corpus_sink(spark, src, out, name=f"s{abs(hash(tmpdir_path))}")
    q.awaitTermination(120)
    got = spark.read.parquet(out).collect()
    assert [r["tokens"] for r in got] == [["topic", "models", "corpora"]]


def test_windowed_term_counts(spark, tmpdir_path):
    src = f"{tmpdir_path}/in2"
    rows = [(1, "topic model topic", dt.datetime(2024, 1, 1, 5)), (2, "model corpora", dt.datetime(2024, 1, 1, 9)),
            (3, "topic", dt.datetime(2024, 1, 3, 1))]
    spark.createDataFrame(rows, CS.DOC_SCHEMA).write.parquet(src)
    name = f"wc{abs(hash(tmpdir_path))}"
    counts = CS.windowed_term_counts(CS.tokenised_stream(spark, src), "1 day", "1 hour")
    q = counts.writeStream.format("memory").queryName(name).outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(str(r["window_start"].date()), r["term"]): r["n"] for r in spark.sql(f"SELECT * FROM {name}").collect()}
    assert got[("2024-01-01", "topic")] == 2
    assert got[("2024-01-01", "model")] == 2
    assert got[("2024-01-03", "topic")] == 1
