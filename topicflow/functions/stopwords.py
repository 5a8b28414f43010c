"""Stop-word lists.

The lists are package data (``stopword_lists/``): the same text files that
Spark's ``StopWordsRemover`` loads, so Spark expressions and the SQL oracle
share the words without a JVM and without Spark's jars.  Catalan, Polish and
Slovak have no list there; pass them as a caller table ``(lang, term)``.
"""

from __future__ import annotations

import functools
from importlib import resources

# ISO code -> list name.
SPARK_LISTS = {
    "da": "danish", "nl": "dutch", "en": "english", "fi": "finnish", "fr": "french",
    "de": "german", "hu": "hungarian", "it": "italian", "no": "norwegian",
    "pt": "portuguese", "ru": "russian", "es": "spanish", "sv": "swedish", "tr": "turkish",
}

# The twelve languages whose union the word filter removes.
MULTI_LANGS = ("en", "es", "de", "it", "ca", "pt", "pl", "da", "ru", "sv", "sk", "nl")


@functools.lru_cache(maxsize=None)
def stopwords(lang: str) -> tuple[str, ...]:
    name = SPARK_LISTS.get(lang, lang)
    path = resources.files(__package__).joinpath("stopword_lists", f"{name}.txt")
    if not path.is_file():
        return ()
    return tuple(w for w in (x.strip() for x in path.read_text(encoding="utf-8").splitlines()) if w)


def available(langs) -> tuple[str, ...]:
    return tuple(l for l in langs if stopwords(l))


def union(langs, extra: dict[str, tuple[str, ...]] | None = None) -> tuple[str, ...]:
    """Words of all ``langs``; ``extra`` gives the lists this package lacks
    (a KeyError names one that neither has)."""
    words: set[str] = set()
    for l in langs:
        words.update(stopwords(l) or (extra or {})[l])
    return tuple(sorted(words))


def table(spark, langs):
    """``(lang, term)`` DataFrame of the available lists (bounded size)."""
    rows = [(l, w) for l in langs for w in stopwords(l)]
    return spark.createDataFrame(rows, "lang string, term string")
