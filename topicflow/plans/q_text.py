"""Queries: sentence chain steps, language vote, token operators, collocations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stopwords
from ..functions import text as T
from ..functions import tokens as K
from ..functions.patterns import NONSPACE_CLASS, NONWORD_CLASS, SPACE_CLASS, WORD_CLASS, sql_quote
from ..operators import collocations, filters, language, language_profiles, vocab
from ..session import spread
from ..sources.tables import read_table
from . import corpus as C
from . import oracle as O
from . import preprocess
from .registry import register

# Markers appended so every step has something to act on (same expression in SQL).
MARKERS = " fooBar &gt note !! . product received for free. heeelp (aside) a*b * c me@x.org  end"


def _marked(spark, d):
    docs = spread(read_table(spark, d, "documents").select("doc_id", "text"))     # a file of one row group would be one task
    return docs.select("doc_id", F.concat("text", F.lit(MARKERS)).alias("s"))


MARKED_SQL = f"(SELECT doc_id, text || {sql_quote(MARKERS)} AS s FROM documents)"

# DuckDB forms of the steps (RE2; `.` already stops at newline only).
SQL_STEPS = {
    "t1": lambda e: f"regexp_replace({e}, '([a-z])([A-Z])', '\\1. \\2', 'g')",
    "t2": lambda e: f"lower({e})",
    "t3": lambda e: f"regexp_replace({e}, '&gt|&lt', ' ', 'g')",
    "t4": lambda e: _sql_t4(e),
    "t6": lambda e: f"regexp_replace({e}, '\\*|{NONWORD_CLASS}\\*|\\*{NONWORD_CLASS}', '. ', 'g')",
    "t7": lambda e: f"regexp_replace({e}, '\\(.*?\\)', '. ', 'g')",
    "t8": lambda e: f"regexp_replace({e}, '{NONWORD_CLASS}+?\\.', '.', 'g')",
    "t9": lambda e: f"regexp_replace({e}, '([.?!])({WORD_CLASS})', '\\1 \\2', 'g')",
    "t10": lambda e: f"regexp_replace({e}, ' ing ', ' ', 'g')",
    "t11": lambda e: f"regexp_replace({e}, 'product received for free[.| ]', ' ', 'g')",
    "t13": lambda e: f"regexp_replace({e}, '{NONSPACE_CLASS}*@{NONSPACE_CLASS}*{SPACE_CLASS}?', '', 'g')",
    "t14": lambda e: f"regexp_replace({e}, '{SPACE_CLASS}+', ' ', 'g')",
    "t15": lambda e: f"trim(regexp_replace(regexp_replace({e}, '''', ' ', 'g'), '[^a-zA-Z]+', ' ', 'g'))",
}


def _sql_t4(e: str) -> str:
    # RE2 has no back-references: one replace per letter (runs never merge).
    out = e
    for c in "abcdefghijklmnopqrstuvwxyz":
        out = f"regexp_replace({out}, '{c}{c}{c}+', '{c}', 'g')"
    return out


SPARK_STEPS = dict(T.T_STEPS)


def _step_query(step: str):
    def q(spark, d):
        return _marked(spark, d).select("doc_id", SPARK_STEPS[step]("s").alias("s"))
    return q


for _step in ("t1", "t3", "t4", "t6", "t7", "t8", "t9", "t10", "t11", "t13", "t14", "t15"):
    register(f"{_step}_step", f"SELECT doc_id, {SQL_STEPS[_step]('s')} AS s FROM {MARKED_SQL}")(_step_query(_step))


SQL_CHAIN_STEPS = ("t1", "t2", "t3", "t4", "t6", "t7", "t8", "t9", "t10", "t11", "t13", "t14", "t15")


def _sql_chain(e: str) -> str:
    for s in SQL_CHAIN_STEPS:
        e = SQL_STEPS[s](e)
    return e


@register("t16_chain_without_backrefs", f"SELECT doc_id, {_sql_chain('s')} AS s FROM {MARKED_SQL}")
def t16_chain_without_backrefs(spark, d):
    return _marked(spark, d).select("doc_id", T.base_chain("s", skip=("t5", "t12")).alias("s"))


@register("t16_chain_full")
def t16_chain_full(spark, d):
    """Whole f_base chain with T5 and T12 (back-references: no SQL oracle)."""
    return _marked(spark, d).select("doc_id", T.base_chain("s").alias("s"))


@register("t5_t12_backrefs")
def t5_t12_backrefs(spark, d):
    m = _marked(spark, d)
    return m.select("doc_id", T.t5_nonword_repeat("s").alias("t5"),
                    T.t12_phrase_repeat(F.lower("s")).alias("t12"))


# --- T17 language vote -------------------------------------------------------

VOTE_LANGS = tuple(stopwords.SPARK_LISTS)


def _sw_values() -> str:
    rows = [f"({sql_quote(l)}, {sql_quote(w)})" for l in VOTE_LANGS for w in stopwords.stopwords(l)]
    return "sw(lang, term) AS (VALUES " + ", ".join(rows) + ")"


LETTER_TOKENS = r"\p{L}+"


@register("t17_language_vote", f"""
WITH {_sw_values()},
toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{LETTER_TOKENS}')) AS term FROM documents),
hits AS (SELECT doc_id, lang, count(*) AS hits FROM toks JOIN sw USING (term) GROUP BY ALL)
SELECT doc_id, lang AS detected_lang, hits FROM hits
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, lang) = 1
""")
def t17_language_vote(spark, d):
    docs = spread(read_table(spark, d, "documents").select("doc_id", "text"))
    toks = docs.select("doc_id", K.extract(F.lower("text"), LETTER_TOKENS).alias("tokens"))
    return language.vote(toks, langs=VOTE_LANGS)


_PROFILE_CTES = f"""
words AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '{LETTER_TOKENS}')) AS w FROM documents),
uw AS (SELECT w, unnest(list_transform(range(1, greatest(length(w), 1) + 1), lambda i: substr(' ' || w || ' ', i, 3))) AS gram FROM (SELECT DISTINCT w FROM words)),
prof AS (SELECT lang, gram, sum(n) AS c FROM (SELECT lang, w, count(*) AS n FROM words WHERE doc_id % 5 <> 0 AND lang IS NOT NULL GROUP BY ALL) JOIN uw USING (w) GROUP BY ALL),
cost AS (SELECT lang, CAST(round(ln(sum(c) + (SELECT count(DISTINCT gram) FROM prof)) * 1000000) AS BIGINT) AS cost FROM prof GROUP BY lang),
ws AS (SELECT w, lang, sum(coalesce(wt, 0)) - count(*) * any_value(cost) AS s
       FROM uw CROSS JOIN cost LEFT JOIN (SELECT lang, gram, CAST(round(ln(c + 1) * 1000000) AS BIGINT) AS wt FROM prof) USING (lang, gram) GROUP BY w, lang),
scored AS (SELECT doc_id, ws.lang, sum(s * n) AS s FROM (SELECT doc_id, w, count(*) AS n FROM words GROUP BY ALL) JOIN ws USING (w) GROUP BY ALL),
best AS (SELECT doc_id, lang AS detected_lang, s FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) = 1),
judged AS (SELECT d.doc_id, d.lang, d.doc_id % 5 = 0 AS held_out, detected_lang, s FROM documents d LEFT JOIN best USING (doc_id))"""


def _profiles(spark, d):
    """Learned from the rows outside the held-out fold (a fifth of the ids), applied to all rows."""
    docs = spread(read_table(spark, d, "documents").select("doc_id", "lang", "text"))
    toks = docs.select("doc_id", "lang", (F.col("doc_id") % 5 == 0).alias("held_out"), K.extract(F.lower("text"), LETTER_TOKENS).alias("tokens"))
    found = language_profiles.classify(toks, language_profiles.learn(toks.where(~F.col("held_out"))))
    return toks, toks.select("doc_id", "lang", "held_out").join(found, "doc_id")


@register("t17_language_profiles", f"""
WITH {_PROFILE_CTES.strip()}
SELECT doc_id, held_out, detected_lang, round(s / 1000000, 6) AS score FROM judged
""")
def t17_language_profiles(spark, d):
    _, judged = _profiles(spark, d)
    return judged.select("doc_id", "held_out", "detected_lang", F.round("score", 6).alias("score"))


@register("t17_profiles_against_vote", f"""
WITH {_sw_values()},
toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{LETTER_TOKENS}')) AS term FROM documents),
hits AS (SELECT doc_id, lang, count(*) AS hits FROM toks JOIN sw USING (term) GROUP BY ALL),
vote AS (SELECT doc_id, lang AS voted FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, lang) = 1),
{_PROFILE_CTES.strip()}
SELECT lang, count(*) AS n_docs, count(*) FILTER (detected_lang = lang) AS profile_right, count(*) FILTER (voted = lang) AS vote_right
FROM judged LEFT JOIN vote USING (doc_id) WHERE held_out GROUP BY lang
""")
def t17_profiles_against_vote(spark, d):
    """Held-out documents each way names right, by language."""
    toks, judged = _profiles(spark, d)
    vote = language.vote(toks, langs=VOTE_LANGS).select("doc_id", F.col("detected_lang").alias("voted"))
    right = lambda c: F.count(F.when(F.col(c) == F.col("lang"), 1))
    return judged.where("held_out").join(vote, "doc_id", "left").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"), right("detected_lang").alias("profile_right"), right("voted").alias("vote_right"))


@register("k12_sentence_english")
def k12_sentence_english(spark, d):
    """f_base chain, then null unless the stop-word vote says English."""
    docs = spread(read_table(spark, d, "documents").select("doc_id", "text"))
    return preprocess.sentences(docs, langs=VOTE_LANGS)


# --- token operators ---------------------------------------------------------

@register("k1_word_tokenize", f"""
SELECT doc_id, array_to_string(list_filter(string_split_regex({SQL_STEPS['t15']('lower(text)')}, ' +'), lambda t: t <> ''), ' ') AS tokens,
       len(list_filter(string_split_regex({SQL_STEPS['t15']('lower(text)')}, ' +'), lambda t: t <> '')) AS n_tokens
FROM documents
""")
def k1_word_tokenize(spark, d):
    docs = spread(read_table(spark, d, "documents").select("doc_id", "text"))
    t = docs.select("doc_id", K.word_tokenize(T.t15_ascii_letters(F.lower("text"))).alias("t"))
    return t.select("doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("long").alias("n_tokens"))


@register("k2_alpha_filter", """
SELECT doc_id, len(list_filter(string_split_regex(lower(text), '[ \\t\\n]+'), lambda t: regexp_full_match(t, '\\p{L}+'))) AS n_alpha
FROM documents
""")
def k2_alpha_filter(spark, d):
    docs = spread(read_table(spark, d, "documents").select("doc_id", "text"))
    toks = F.split(F.lower("text"), "[ \t\n]+")
    return docs.select("doc_id", F.size(K.alpha_only(toks)).cast("long").alias("n_alpha"))


MULTI = stopwords.available(stopwords.MULTI_LANGS)


@register("k5_multilang_stopwords", f"""
SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '{K.VOCAB_TOKEN}'),
        lambda t: NOT list_contains({O.sql_list(stopwords.union(MULTI))}, t)), ' ') AS tokens
FROM documents
""")
def k5_multilang_stopwords(spark, d):
    # Nine of the twelve lists ship with the package; a caller gives ca, pl and sk to ``stopwords.union``.
    docs = spread(read_table(spark, d, "documents").select("doc_id", "text"))
    t = K.remove_words(K.vocab_tokens("text"), stopwords.union(MULTI))
    return docs.select("doc_id", F.array_join(t, " ").alias("tokens"))


@register("k6_english_stopwords", f"""
WITH {O.restricted_ctes()},
joined AS (SELECT doc_id, string_agg(term, ' ' ORDER BY pos) AS text FROM rlong GROUP BY doc_id)
SELECT doc_id, trim(array_to_string(list_filter(string_split(text, ' '), lambda t: NOT list_contains({O.stop_en()}, t)), ' ')) AS text
FROM joined
""")
def k6_english_stopwords(spark, d):
    rc = C.restricted_corpus(spark, d)
    toks = F.split(F.array_join("tokens", " "), " ")
    return rc.select("doc_id", F.trim(F.array_join(K.remove_words(toks, stopwords.stopwords("en")), " ")).alias("text"))


@register("k10_simple_tokenize", f"""
SELECT concat(conv_id, chr(58), turn) AS doc_id, array_to_string({O.simple_tokenize('text')}, ' ') AS tokens FROM conversations
""")
def k10_simple_tokenize(spark, d):
    c = read_table(spark, d, "conversations")
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"),
                    F.array_join(K.simple_tokenize("text"), " ").alias("tokens"))


@register("k11_markup_tokenize", f"""
SELECT page_id, array_to_string({O.simple_tokenize(f"regexp_replace(html, '{K.TAG}', '', 'g')")}, ' ') AS tokens FROM pages
""")
def k11_markup_tokenize(spark, d):
    p = read_table(spark, d, "pages").select("page_id", "html")
    return p.select("page_id", F.array_join(K.markup_tokenize("html"), " ").alias("tokens"))


@register("p7_drop_empty", f"""
SELECT concat(conv_id, chr(58), turn) AS doc_id, len({O.simple_tokenize('text')}) AS n_tokens FROM conversations
WHERE len({O.simple_tokenize('text')}) > 0
""")
def p7_drop_empty(spark, d):
    c = read_table(spark, d, "conversations")
    t = c.select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), K.simple_tokenize("text").alias("tokens"))
    return filters.drop_empty(t).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"))


@register("p8_tokens_to_text", f"""
WITH {O.restricted_ctes()}
SELECT doc_id, string_agg(term, ' ' ORDER BY pos) AS text FROM rlong GROUP BY doc_id
""")
def p8_tokens_to_text(spark, d):
    return C.restricted_corpus(spark, d).select("doc_id", K.join_tokens("tokens").alias("text"))


@register("p6_strip", f"""
SELECT doc_id, regexp_replace(text, '\\A{SPACE_CLASS}+|{SPACE_CLASS}+\\z', '', 'g') AS text FROM documents
""")
def p6_strip(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", T.strip_outer("text").alias("text"))


# --- collocations ----------------------------------------------------------------

COLLOC_MIN, COLLOC_THRESHOLD = 5, 100.0


def _colloc_sql(final: str) -> str:
    return f"""
WITH {O.restricted_ctes()},
bi AS (SELECT doc_id, pos, term AS a, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM rlong),
uni AS (SELECT term, count(*) AS n FROM rlong GROUP BY term),
bic AS (SELECT a, b, count(*) AS n_ab FROM bi WHERE b IS NOT NULL GROUP BY ALL),
v AS (SELECT (SELECT count(*) FROM uni) + (SELECT count(*) FROM bic) AS V),
ph AS (SELECT a, b, n_ab, (n_ab - {COLLOC_MIN}) / (ua.n * ub.n) * (SELECT V FROM v) AS score
       FROM bic JOIN uni ua ON ua.term = a JOIN uni ub ON ub.term = b
       WHERE n_ab >= {COLLOC_MIN} AND (n_ab - {COLLOC_MIN}) / (ua.n * ub.n) * (SELECT V FROM v) > {COLLOC_THRESHOLD})
{final}"""


@register("k7_collocations", _colloc_sql("SELECT a, b, n_ab, round(score, 6) AS score FROM ph"))
def k7_collocations(spark, d):
    long = C.restricted_long(spark, d).select("doc_id", "pos", "term")
    ph = collocations.learn(long, COLLOC_MIN, COLLOC_THRESHOLD)
    return ph.select("a", "b", "n_ab", F.round("score", 6).alias("score"))


@register("k8_apply_collocations", _colloc_sql("""
, x AS (SELECT r.doc_id, r.pos, r.term, lead(r.term) OVER (PARTITION BY r.doc_id ORDER BY r.pos) AS nx FROM rlong r),
h AS (SELECT x.*, (ph.a IS NOT NULL) AS hit FROM x LEFT JOIN ph ON ph.a = x.term AND ph.b = x.nx),
s AS (SELECT h.*, hit AND NOT coalesce(lag(hit) OVER (PARTITION BY doc_id ORDER BY pos), false) AS st FROM h),
r AS (SELECT s.*, sum(CAST(st AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM s),
k AS (SELECT r.*, row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) - 1 AS kk FROM r),
tk AS (SELECT k.*, hit AND kk % 2 = 0 AS take FROM k),
c AS (SELECT tk.*, coalesce(lag(take) OVER (PARTITION BY doc_id ORDER BY pos), false) AS consumed FROM tk)
SELECT doc_id, string_agg(CASE WHEN take THEN term || '_' || nx ELSE term END, ' ' ORDER BY pos) AS text
FROM c WHERE NOT consumed GROUP BY doc_id""".replace("\n, x AS", ", x AS", 1).replace("{final}", "")))
def k8_apply_collocations(spark, d):
    long = C.restricted_long(spark, d).select("doc_id", "pos", "term")
    ph = collocations.learn(long, COLLOC_MIN, COLLOC_THRESHOLD)
    out = collocations.apply(long, ph)
    return (out.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("_t"))
               .select("doc_id", F.array_join(F.transform("_t", lambda x: x["term"]), " ").alias("text")))
