"""Queries: vocabularies and document-term aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tokens import ALPHA2_TOKEN
from ..operators import vocab
from . import corpus as C
from . import oracle as O
from .registry import r6, register


@register("v1_vocab_df_bounded", f"""
WITH {O.restricted_ctes()} SELECT term, df FROM vocab
""")
def v1_vocab_df_bounded(spark, d):
    return vocab.doc_freq_vocabulary(C.raw_corpus(spark, d))


@register("v2_vocab_top2000", f"""
WITH {O.restricted_ctes()},
ctm AS (SELECT doc_id, regexp_extract_all(s, '{ALPHA2_TOKEN}') AS toks FROM (
        SELECT doc_id, lower(string_agg(term, ' ' ORDER BY pos)) AS s FROM rlong GROUP BY doc_id))
SELECT term, count(*) AS n FROM (SELECT unnest(toks) AS term FROM ctm) GROUP BY term
ORDER BY n DESC, term LIMIT 2000
""")
def v2_vocab_top2000(spark, d):
    rc = C.restricted_corpus(spark, d)
    toks = rc.select(F.regexp_extract_all(F.lower(F.array_join("tokens", " ")), F.lit(ALPHA2_TOKEN), F.lit(0)).alias("tokens"))
    return vocab.frequency_capped_vocabulary(toks, "tokens", 2000)


@register("v3_vocab_min_count_conversations", f"""
WITH {O.tokenise_cte('conv', 'SELECT concat(conv_id, chr(58), turn) AS doc_id, text FROM conversations')}
SELECT term, count(*) AS n FROM (SELECT unnest(tokens) AS term FROM conv) GROUP BY term HAVING count(*) > 20
""")
def v3_vocab_min_count_conversations(spark, d):
    return vocab.min_count_vocabulary(C.conversation_corpus(spark, d), "tokens", 20)


@register("v4_restrict_to_vocabulary", f"""
WITH {O.restricted_ctes()}
SELECT doc_id, string_agg(term, ' ' ORDER BY pos) AS tokens, count(*) AS n_tokens FROM rlong GROUP BY doc_id
""")
def v4_restrict_to_vocabulary(spark, d):
    raw = C.raw_corpus(spark, d)
    r = vocab.restrict_to_vocabulary(raw, vocab.doc_freq_vocabulary(raw))
    return r.select("doc_id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").cast("long").alias("n_tokens"))


@register("v5_dictionary", f"""
WITH {O.restricted_ctes()}
SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM vocab
""")
def v5_dictionary(spark, d):
    return vocab.dictionary(vocab.doc_freq_vocabulary(C.raw_corpus(spark, d)))


@register("v6_bag_of_words", f"""
WITH {O.restricted_ctes()},
dict AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM vocab)
SELECT doc_id, term_id, count(*) AS n FROM rlong JOIN dict USING (term) GROUP BY ALL
""")
def v6_bag_of_words(spark, d):
    raw = C.raw_corpus(spark, d)
    voc = vocab.doc_freq_vocabulary(raw)
    return vocab.bag_of_words(C.restricted_long(spark, d).select("doc_id", "pos", "term"), vocab.dictionary(voc))


@register("v7_term_totals", f"""
WITH {O.restricted_ctes()} SELECT term, count(*) AS n FROM rlong GROUP BY term
""")
def v7_term_totals(spark, d):
    return vocab.term_counts(C.restricted_corpus(spark, d))


@register("v8_tfidf", f"""
WITH {O.restricted_ctes()},
tf AS (SELECT doc_id, term, count(*) AS tf FROM rlong GROUP BY ALL),
nd AS (SELECT count(DISTINCT doc_id) AS n FROM tf),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT doc_id, term, tf, tf * (ln((n + 1) / (df + 1)) + 1) AS raw FROM tf JOIN dfq USING (term) CROSS JOIN nd),
nr AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM w GROUP BY doc_id)
SELECT doc_id, term, tf, round(raw / norm, 6) AS weight FROM w JOIN nr USING (doc_id)
""")
def v8_tfidf(spark, d):
    t = vocab.tfidf(C.restricted_long(spark, d).select("doc_id", "pos", "term"))
    return t.select("doc_id", "term", "tf", r6("weight").alias("weight"))


@register("v9_metadata", f"""
WITH {O.restricted_ctes()}
SELECT (SELECT count(*) FROM raw) AS total_documents, (SELECT count(*) FROM vocab) AS vocabulary_length
""")
def v9_metadata(spark, d):
    raw = C.raw_corpus(spark, d)
    return vocab.metadata(raw, vocab.doc_freq_vocabulary(raw))


@register("v10_dataset_size", f"""
WITH {O.restricted_ctes()} SELECT count(DISTINCT doc_id) AS dataset_size FROM rlong
""")
def v10_dataset_size(spark, d):
    return vocab.dataset_size(C.restricted_corpus(spark, d))
