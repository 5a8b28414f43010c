"""The stages in a row against plain versions of each, and the registry's guard."""

import hashlib
import subprocess
import sys
from pathlib import Path

import numpy as np

import corpus_pipeline
from tests.llm import test_decontam, test_line_dedup, test_simhash
from topicflow.llm import bpe, line_dedup, toxicity
from topicflow.llm.common import read_table

SF = "/root/testdata/sf0.001"


def test_run_against_plain_stages(spark):
    docs = read_table(spark, SF, "documents")
    labels = read_table(spark, SF, "labels")
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    kept = toxicity.keep_clean(docs, labels).collect()                      # a trained model: itself, tested elsewhere
    rows = test_line_dedup.plain_dedup([(r["doc_id"], r["text"]) for r in kept], line_dedup.Params())
    fps = [test_simhash.plain_fingerprint(t) for _, t in rows]
    roots = test_simhash.plain_components(fps)
    least = {}
    for (i, _), r in zip(rows, roots):
        least[r] = min(i, least.get(r, i))
    rows = [(i, t) for (i, t), r in zip(rows, roots) if least[r] == i]
    items = [tuple(r) for r in read_table(spark, SF, "benchmark").select("item_id", "text").collect()]
    bad = {x[0] for x in test_decontam.plain(rows, items) if x[5]}
    rows = [(i, t) for i, t in rows if i not in bad]
    e = bpe.Encoder()
    want = []
    for (i, t), ids in zip(rows, e.encode([t for _, t in rows])):
        want.append((i, len(np.frombuffer(ids, "<u4")), hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert 20 < len(got) < docs.count()


def test_stages_keep_columns_and_values(spark):
    """Columns named like the operators' own, null ids and texts, repeated rows: all that stays has its values."""
    docs = read_table(spark, SF, "documents").limit(30).withColumnRenamed("source", "score")
    for k, name in enumerate(["source", "th", "fp", "_d", "_id", "_th", "_gone", "_new", "held_out", "predicted", "row", "a", "id", "gone"]):
        docs = docs.selectExpr("*", f"concat('{name}', doc_id) as {name}", *([] if k else ["cast(doc_id as string) as tag"]))
    more = docs.limit(2)
    odd = docs.limit(1).selectExpr(*[f"cast(null as {t}) as {c}" if c in ("doc_id", "text") else c for c, t in docs.dtypes])
    docs = docs.unionByName(more).unionByName(odd).unionByName(odd.selectExpr(*["'' as text" if c == "text" else c for c in docs.columns])).cache()
    rows = {(r["doc_id"], r["tag"]): r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        got = out.collect()
        assert len(got) > 10, name
        for r in got:
            same = rows[r["doc_id"], r["tag"]]
            assert all(r[c] == same[c] for c in docs.columns if c not in ("text", "n_chars")), name
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "byte-level BPE"]


def test_entry_works_without_the_subpackage(tmp_path):
    import shutil
    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "topicflow", tmp_path / "topicflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True).returncode == 0
