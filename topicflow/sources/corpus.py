"""Corpus sources and sinks.

``DATASETS`` maps a dataset name to a reader spec (S1).  CSV corpora are
headerless with the text at a numbered column (S2); named loaders lower-
case, turn newlines into spaces and drop texts of 2 characters or less
(P1-P3); two of them take a seeded exact-size sample (P4).  Document
identity is an explicit ``doc_id`` (row position in the source), never
list order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import filters
from ..session import spread


@dataclass(frozen=True)
class CsvSpec:
    path: str            # relative to the caller's data root
    text_col: int
    min_length: int | None = 2
    sample: int | None = None


# Dataset name -> file and text column, as the named loaders use them.
DATASETS = {
    "agnews": CsvSpec("agnews/ag_news_csv/train.csv", 2),
    "yelp": CsvSpec("yelp/yelp_review_full_csv/train.csv", 1, sample=120000),
    "yelp_full": CsvSpec("yelp/yelp_review_full_csv/train.csv", 1),
    "dbpedia": CsvSpec("dbpedia/dbpedia_csv/train.csv", 2, sample=120000),
    "dbpedia_full": CsvSpec("dbpedia/dbpedia_csv/train.csv", 2),
    "reuters": CsvSpec("reuters21578/reuters-21578-json/reuters_21578.csv", 0),
    "StackOverflow": CsvSpec("StackOverflow/train.csv", 0, min_length=None),
    "yahoo_answer": CsvSpec("yahoo_answer/train.csv", 0, min_length=None),
}


def read_csv_corpus(spark: SparkSession, path: str, text_col: int) -> DataFrame:
    """Column ``text_col`` of a headerless CSV as ``(doc_id, text)``.

    Only that column is parsed (CSV column pruning).  ``doc_id`` is the
    row position (distributed dense index, no single-task window).
    """
    ncols = text_col + 1
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(ncols)])
    df = (spark.read.schema(schema).option("header", False).option("multiLine", True)
               .option("escape", '"').csv(path).select(F.col(f"_c{text_col}").alias("text")))
    return filters.dense_index(df, "doc_id").select("doc_id", "text")


def load_docs(spark: SparkSession, name: str, root: str, seed: int = 0) -> DataFrame:
    """Named dataset -> cleaned ``(doc_id, text)``."""
    spec = DATASETS[name]
    df = read_csv_corpus(spark, f"{root.rstrip('/')}/{spec.path}", spec.text_col)
    if spec.sample:
        df = filters.exact_sample(df, spec.sample, "doc_id", seed)
    return filters.loader_clean(df, "text", spec.min_length)


def load_documents(df: DataFrame, text_col: str = "text", id_col: str | None = None) -> DataFrame:
    """S3: caller-supplied documents (any DataFrame) as ``(doc_id, text)``."""
    if id_col is None:
        df = filters.dense_index(df, "doc_id")
        id_col = "doc_id"
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def write_lines(df: DataFrame, path: str, col: str = "text", mode: str = "overwrite") -> None:
    """One document per line (newlines must already be removed)."""
    df.select(F.regexp_replace(col, "[\r\n]", " ").alias("value")).write.mode(mode).text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """S5 + P6: one document per line, outer whitespace stripped."""
    from ..functions.text import strip_outer
    df = spark.read.text(path).select(strip_outer("value").alias("text"))
    return filters.dense_index(df, "doc_id").select("doc_id", "text")


def save_dataset(corpus: DataFrame, vocabulary: DataFrame, total_documents: int | None, path: str,
                 info: str = "process") -> None:
    """Tokenised dataset as three Parquet tables under ``path``:
    ``corpus (doc_id, doc_index, tokens)``, ``vocabulary (term)``,
    ``metadata (key, value)``.  ``doc_index`` is the position among
    surviving documents (range-partitioned sort + offsets)."""
    spark = corpus.sparkSession
    c = filters.dense_index(corpus.orderBy("doc_id"), "doc_index")
    c.select("doc_id", "doc_index", "tokens").write.mode("overwrite").parquet(f"{path}/corpus")
    vocabulary.select("term").orderBy("term").write.mode("overwrite").parquet(f"{path}/vocabulary")
    n_vocab = vocabulary.count()
    meta = [("total_documents", str(total_documents if total_documents is not None else corpus.count())),
            ("vocabulary_length", str(n_vocab)), ("preprocessing-info", info)]
    spark.createDataFrame(meta, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def load_dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Read back what ``save_dataset`` wrote."""
    return {k: spark.read.parquet(f"{path}/{k}") for k in ("corpus", "vocabulary", "metadata")}


def read_embeddings(spark: SparkSession, path: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Precomputed vectors keyed by id (encoding happens once, upstream)."""
    return spread(spark.read.parquet(path).select(F.col(id_col).alias("doc_id"), F.col(vec_col).alias("embedding")))
