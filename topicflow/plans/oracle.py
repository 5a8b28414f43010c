"""DuckDB SQL fragments mirroring the Spark plans, for the independent oracle.

The oracle is written in set/brute-force style (exploded windows, list
functions) rather than by translating the Spark plans.
"""

from __future__ import annotations

from ..functions import stopwords
from ..functions.patterns import (ACCENT_FROM, ACCENT_TO, NONSPACE_CLASS, NONWORD_CLASS,
                                  SPACE_CLASS, WORD_CLASS, sql_quote)
from ..functions.tokens import SIMPLE_TOKEN, VOCAB_TOKEN


def sql_list(words) -> str:
    return "[" + ", ".join(sql_quote(w) for w in words) + "]"


def stop_en() -> str:
    return sql_list(stopwords.stopwords("en"))


def docs_cte() -> str:
    return ("docs AS (SELECT doc_id, lang, source, replace(lower(text), chr(10), ' ') AS text "
            "FROM documents WHERE text IS NOT NULL AND length(text) > 2)")


def tokenise_cte(name: str, select_from: str, keep: str = "") -> str:
    """``name(doc_id, {keep}, tokens)`` from ``select_from`` giving doc_id, text[, keep]."""
    k = f"{keep}, " if keep else ""
    return f"""{name} AS (SELECT doc_id, {k}
        list_filter(regexp_extract_all(lower(replace(lower(text), chr(10), ' ')), '{VOCAB_TOKEN}'), lambda t: NOT list_contains({stop_en()}, t)) AS tokens
        FROM ({select_from}) WHERE text IS NOT NULL AND length(text) > 2)"""


def long_cte(name: str, src: str, keep: str = "") -> str:
    k = f"{keep}, " if keep else ""
    return (f"{name} AS (SELECT doc_id, {k}unnest(tokens) AS term, unnest(range(len(tokens))) AS pos, "
            f"len(tokens) AS n FROM {src})")


def raw_ctes() -> str:
    """docs, raw (doc tokens), raw_long (doc_id, lang, source, term, rawpos)."""
    return f"""{docs_cte()},
raw AS (SELECT doc_id, lang, source,
        list_filter(regexp_extract_all(lower(text), '{VOCAB_TOKEN}'), lambda t: NOT list_contains({stop_en()}, t)) AS tokens
        FROM docs),
raw_long AS (SELECT doc_id, lang, source, unnest(tokens) AS term, unnest(range(len(tokens))) AS rawpos FROM raw)"""


def restricted_ctes() -> str:
    """... + vocab (term, df) and rlong (doc_id, lang, source, term, pos, n)."""
    return f"""{raw_ctes()},
ndocs AS (SELECT count(*) AS n FROM raw),
vocab AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, term FROM raw_long) GROUP BY term
          HAVING count(*) >= 0.00002::DOUBLE * (SELECT n FROM ndocs) AND count(*) <= 0.99::DOUBLE * (SELECT n FROM ndocs)),
rlong AS (SELECT doc_id, lang, source, term,
                 row_number() OVER (PARTITION BY doc_id ORDER BY rawpos) - 1 AS pos,
                 count(*) OVER (PARTITION BY doc_id) AS n
          FROM raw_long WHERE term IN (SELECT term FROM vocab))"""


def class_topics_ctes(class_col: str, name: str = "topics", k: int = 10, src: str = "rlong") -> str:
    """c-TF-IDF over ``src`` grouped by ``class_col`` -> ``name(topic, rank, term, weight)``."""
    return f"""{name}_cnt AS (SELECT {class_col} AS topic, term, count(*) AS n FROM {src} GROUP BY ALL),
{name}_tot AS (SELECT topic, sum(n) AS tot FROM {name}_cnt GROUP BY topic),
{name}_f AS (SELECT term, sum(n) AS f FROM {name}_cnt GROUP BY term),
{name}_a AS (SELECT floor(avg(tot)) AS a FROM {name}_tot),
{name}_w AS (SELECT topic, term, n, (n / tot) * ln(1.0 + a / f) AS weight
             FROM {name}_cnt JOIN {name}_tot USING (topic) JOIN {name}_f USING (term) CROSS JOIN {name}_a),
{name} AS (SELECT topic, term, weight, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) - 1 AS rank
           FROM {name}_w QUALIFY rank < {k})"""


def fold_accents(expr: str) -> str:
    return f"translate({expr}, {sql_quote(ACCENT_FROM)}, {sql_quote(ACCENT_TO)})"


def simple_tokenize(expr: str) -> str:
    toks = f"regexp_extract_all({fold_accents(f'lower({expr})')}, '{SIMPLE_TOKEN}')"
    return f"list_filter({toks}, lambda t: length(t) >= 2 AND length(t) <= 15 AND NOT starts_with(t, '_'))"


CLASSES = {"WORD": WORD_CLASS, "NONWORD": NONWORD_CLASS, "SPACE": SPACE_CLASS, "NONSPACE": NONSPACE_CLASS}
