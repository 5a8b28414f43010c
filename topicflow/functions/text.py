"""Sentence-level normalisation (T1-T16) and loader normalisation.

Each step is one native ``regexp_replace`` so the chain compiles into a
single projection inside whole-stage codegen.  The step order is part of the
contract.  ``(?d)`` makes ``.`` stop only at ``\\n`` as Python's does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import NONSPACE_CLASS, NONWORD_CLASS, SPACE_CLASS, WORD_CLASS
from .repeats import collapse

# Boilerplate phrase removed by T11 (default list).
DEFAULT_NOISE_PHRASES = ("product received for free",)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- loader normalisation -------------------------------------------------

def loader_normalise(col) -> Column:
    """Lower-case and newline -> space (every named loader does this)."""
    return F.regexp_replace(F.lower(_c(col)), "\n", " ")


def strip_outer(col) -> Column:
    """Strip outer (Unicode) whitespace like ``str.strip``."""
    return F.regexp_replace(_c(col), f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


# --- T1 ... T15 -------------------------------------------------------------

def t1_split_camel(col) -> Column:
    return F.regexp_replace(_c(col), "([a-z])([A-Z])", "$1. $2")


def t2_lower(col) -> Column:
    return F.lower(_c(col))


def t3_drop_gt_lt(col) -> Column:
    return F.regexp_replace(_c(col), "&gt|&lt", " ")


def t4_letter_repeat(col) -> Column:
    return F.regexp_replace(_c(col), r"([a-z])\1{2,}", "$1")


def t5_nonword_repeat(col) -> Column:
    return F.regexp_replace(_c(col), f"({NONWORD_CLASS})\\1+", "$1")


def t6_star_bullets(col) -> Column:
    return F.regexp_replace(_c(col), f"\\*|{NONWORD_CLASS}\\*|\\*{NONWORD_CLASS}", ". ")


def t7_parentheses(col) -> Column:
    return F.regexp_replace(_c(col), r"(?d)\(.*?\)", ". ")


def t8_nonword_before_period(col) -> Column:
    return F.regexp_replace(_c(col), f"{NONWORD_CLASS}+?\\.", ".")


def t9_space_after_stop(col) -> Column:
    return F.regexp_replace(_c(col), f"([.?!])({WORD_CLASS})", "$1 $2")


def t10_drop_ing(col) -> Column:
    return F.regexp_replace(_c(col), " ing ", " ")


def t11_noise_phrases(col, phrases: Sequence[str] = DEFAULT_NOISE_PHRASES) -> Column:
    out = _c(col)
    for p in phrases:
        out = F.regexp_replace(out, _java_quote(p) + "[.| ]", " ")
    return out


def t12_phrase_repeat(col) -> Column:
    """Collapse a repeated phrase of 2+ characters to one copy (``banana`` -> ``bana``).

    The same as ``(.{2,}?)\\1+`` -> ``\\1``, whose matcher tries every length at
    every place (the square of a line's length); see ``repeats``.
    """
    @F.arrow_udf("string")
    def one(texts):
        import pyarrow as pa
        return pa.array(collapse(texts.to_pylist()), pa.string())
    return one(_c(col))


def t13_drop_emails(col) -> Column:
    return F.regexp_replace(_c(col), f"{NONSPACE_CLASS}*@{NONSPACE_CLASS}*{SPACE_CLASS}?", "")


def t14_collapse_space(col) -> Column:
    return F.regexp_replace(_c(col), f"{SPACE_CLASS}+", " ")


def t15_ascii_letters(col) -> Column:
    s = F.regexp_replace(_c(col), "'", " ")
    return F.trim(F.regexp_replace(s, "[^a-zA-Z]+", " "))


# Order is the contract of f_base.
T_STEPS = (
    ("t1", t1_split_camel), ("t2", t2_lower), ("t3", t3_drop_gt_lt),
    ("t4", t4_letter_repeat), ("t5", t5_nonword_repeat), ("t6", t6_star_bullets),
    ("t7", t7_parentheses), ("t8", t8_nonword_before_period), ("t9", t9_space_after_stop),
    ("t10", t10_drop_ing), ("t11", t11_noise_phrases), ("t12", t12_phrase_repeat),
    ("t13", t13_drop_emails), ("t14", t14_collapse_space), ("t15", t15_ascii_letters),
)


def base_chain(col, skip: Sequence[str] = ()) -> Column:
    """The whole sentence chain (optionally without some steps)."""
    out = _c(col)
    for name, fn in T_STEPS:
        if name not in skip:
            out = fn(out)
    return out


def _java_quote(s: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in s)
