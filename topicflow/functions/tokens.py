"""Token-level Column expressions (K1, K2, K5, K6, K10, K11 and token patterns)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import ACCENT_FROM, ACCENT_TO
from .text import _c

# Document-frequency vocabulary token pattern (3+ word chars,
# pipe or hyphen), written as an explicit class instead of \b...\b.
VOCAB_TOKEN = r"[\p{L}\p{N}_|\-]{3,}"
# Simple tokenizer keeps runs of non-digit word characters.
SIMPLE_TOKEN = r"[\p{L}\p{Nl}\p{No}_]+"
# Frequency-capped vocabulary token pattern.
ALPHA2_TOKEN = r"[a-zA-Z]{2,}"
TAG = r"<([^>]+)>"


def extract(col, pattern: str) -> Column:
    return F.regexp_extract_all(_c(col), F.lit(pattern), F.lit(0))


def word_tokenize(col) -> Column:
    """K1: split a letters-and-spaces sentence on spaces."""
    return F.filter(F.split(_c(col), " +"), lambda t: t != "")


def alpha_only(tokens) -> Column:
    """K2: keep purely alphabetic tokens (``str.isalpha``)."""
    return F.filter(_c(tokens), lambda t: t.rlike(r"^\p{L}+$"))


def remove_words(tokens, words: Iterable[str]) -> Column:
    """K5/K6: drop listed words, keeping order and duplicates.

    A literal IN list over 10 entries becomes a hash-set lookup (InSet).
    """
    words = list(words)
    if not words:
        return _c(tokens)
    return F.filter(_c(tokens), lambda t: ~t.isin(words))


def keep_words(tokens, words: Iterable[str]) -> Column:
    words = list(words)
    return F.filter(_c(tokens), lambda t: t.isin(words))


def fold_accents(col) -> Column:
    return F.translate(_c(col), ACCENT_FROM, ACCENT_TO)


def simple_tokenize(col, min_len: int = 2, max_len: int = 15) -> Column:
    """Lower, fold accents, runs of non-digit word chars, length 2..15."""
    toks = extract(fold_accents(F.lower(_c(col))), SIMPLE_TOKEN)
    return F.filter(toks, lambda t: (F.length(t) >= min_len) & (F.length(t) <= max_len)
                    & ~t.startswith("_"))


def strip_tags(col) -> Column:
    return F.regexp_replace(_c(col), TAG, "")


def markup_tokenize(col) -> Column:
    """Remove ``<...>`` tags, then the simple tokenizer."""
    return simple_tokenize(strip_tags(col))


def vocab_tokens(col) -> Column:
    """Lower-cased tokens of the document-frequency vocabulary pattern."""
    return extract(F.lower(_c(col)), VOCAB_TOKEN)


def join_tokens(tokens) -> Column:
    """Tokens -> text."""
    return F.array_join(_c(tokens), " ")
