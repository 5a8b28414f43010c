"""Queries: flagship slice, loader filters, class TF-IDF topics, diversity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coherence, ctfidf, filters
from . import corpus as C
from . import oracle as O
from .registry import r6, register
from ..sources.tables import read_table


# --- flagship: documents -> P1-P3 -> V1 -> V4 -> class TF-IDF by lang -> top 10 -> diversity
def flagship(spark, d):
    topics = C.class_topics(C.restricted_long(spark, d), "lang")
    div = coherence.diversity(topics)
    return (topics.crossJoin(F.broadcast(div))          # one-row side
                  .select("topic", "rank", "term", r6("weight").alias("weight"),
                          r6("diversity").alias("diversity")))


register("flagship_lang_topics", f"""
WITH {O.restricted_ctes()},
{O.class_topics_ctes('lang')},
div AS (SELECT count(DISTINCT term) / (10.0 * count(DISTINCT topic)) AS diversity FROM topics)
SELECT topic, rank, term, round(weight, 6) AS weight, round(diversity, 6) AS diversity FROM topics, div
""")(flagship)


@register("p1_min_length", """
SELECT doc_id, length(text) AS text_length FROM documents WHERE text IS NOT NULL AND length(text) > 200
""")
def p1_min_length(spark, d):
    docs = read_table(spark, d, "documents")
    return (filters.min_length(filters.strings_only(docs), "text", 200)
            .select("doc_id", F.length("text").cast("long").alias("text_length")))


@register("p3_loader_normalise", f"""
WITH {O.docs_cte()} SELECT doc_id, text FROM docs
""")
def p3_loader_normalise(spark, d):
    return filters.loader_clean(read_table(spark, d, "documents")).select("doc_id", "text")


@register("p4_exact_sample", """
SELECT doc_id, lang FROM documents ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)) LIMIT 250
""")
def p4_exact_sample(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "lang")
    return filters.exact_sample(docs, 250, "doc_id", seed=7)


@register("p11_topk_cut", f"""
WITH {O.restricted_ctes()},
{O.class_topics_ctes('source')}
SELECT topic, rank, term FROM topics WHERE rank < 5
""")
def p11_topk_cut(spark, d):
    return filters.top_k_cut(C.source_topics(spark, d), 5).select("topic", "rank", "term")


@register("p12_id_validation", """
SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_distinct_ids,
       CAST(sum(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null_ids,
       CAST(sum(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null_texts,
       count(*) = count(DISTINCT doc_id) AND sum(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) = 0
         AND sum(CASE WHEN text IS NULL THEN 1 ELSE 0 END) = 0 AS valid
FROM documents
""")
def p12_id_validation(spark, d):
    return filters.id_validation(read_table(spark, d, "documents"))


@register("m10_ctfidf_source", f"""
WITH {O.restricted_ctes()},
{O.class_topics_ctes('source')}
SELECT topic, term, n, round(weight, 6) AS weight FROM topics_w
""")
def m10_ctfidf_source(spark, d):
    w = ctfidf.class_tfidf(C.restricted_long(spark, d), ["source"])
    return w.select(F.col("source").alias("topic"), "term", "n", r6("weight").alias("weight"))


@register("m10_ctfidf_quality", f"""
WITH {O.restricted_ctes()},
ql AS (SELECT r.*, CAST(l.quality AS VARCHAR) AS quality FROM rlong r JOIN labels l USING (doc_id)),
{O.class_topics_ctes('quality', src='ql')}
SELECT topic, rank, term, round(weight, 6) AS weight FROM topics
""")
def m10_ctfidf_quality(spark, d):
    labels = read_table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    long = C.restricted_long(spark, d).join(labels, "doc_id")
    t = C.class_topics(long, "quality")
    return t.select("topic", "rank", "term", r6("weight").alias("weight"))


@register("m11_top_words_source", f"""
WITH {O.restricted_ctes()},
{O.class_topics_ctes('source')}
SELECT topic, rank, term, round(weight, 6) AS weight FROM topics
""")
def m11_top_words_source(spark, d):
    return C.source_topics(spark, d).select("topic", "rank", "term", r6("weight").alias("weight"))


@register("q_div_source", f"""
WITH {O.restricted_ctes()},
{O.class_topics_ctes('source')}
SELECT round(count(DISTINCT term) / (10.0 * count(DISTINCT topic)), 6) AS diversity FROM topics
""")
def q_div_source(spark, d):
    return coherence.diversity(C.source_topics(spark, d)).select(r6("diversity").alias("diversity"))


@register("q_uniq_source", f"""
WITH {O.restricted_ctes()},
{O.class_topics_ctes('source')},
cnt AS (SELECT term, count(*) AS c FROM topics GROUP BY term),
per AS (SELECT topic, avg(1.0 / c) AS u FROM topics JOIN cnt USING (term) GROUP BY topic)
SELECT round(avg(u), 6) AS uniqueness FROM per
""")
def q_uniq_source(spark, d):
    return coherence.uniqueness(C.source_topics(spark, d)).select(r6("uniqueness").alias("uniqueness"))


@register("s1_load_docs_registry", f"""
WITH {O.tokenise_cte('conv', 'SELECT concat(conv_id, chr(58), turn) AS doc_id, role, text FROM conversations', 'role')}
SELECT doc_id, role, len(tokens) AS n_tokens FROM conv
""")
def s1_load_docs_registry(spark, d):
    """The registry-named conversation corpus through the loader cleaning."""
    c = C.conversation_corpus(spark, d)
    return c.select("doc_id", "role", F.size("tokens").cast("long").alias("n_tokens"))


@register("p5_sample_with_replacement")
def p5_sample_with_replacement(spark, d):
    """P5: 500 seeded draws with replacement over document positions."""
    docs = read_table(spark, d, "documents").select("doc_id", "lang")
    return filters.sample_with_replacement(docs, 500, seed=3)
