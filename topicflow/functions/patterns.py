"""Regular-expression building blocks shared by the Spark expressions and the
SQL oracle.  Character classes are spelled out so Java and RE2 agree:
``\\w`` is written as letters, numbers and underscore; whitespace as the
Unicode space set Python's ``str.isspace`` uses.
"""

from __future__ import annotations

import unicodedata

WORD = r"\p{L}\p{N}_"                      # Python's Unicode \w
WORD_CLASS = f"[{WORD}]"
NONWORD_CLASS = f"[^{WORD}]"
SPACE = r"\t-\r\x1C-\x1F\x{85}\p{Z}"        # Python's Unicode \s
SPACE_CLASS = f"[{SPACE}]"
NONSPACE_CLASS = f"[^{SPACE}]"


def _accent_fold_pairs() -> tuple[str, str]:
    """Letters whose canonical decomposition is one base letter plus
    combining marks, mapped to that base letter (NFD, drop Mn, NFC).

    Built from the Unicode database by rule for Latin, Greek and Cyrillic
    blocks, so both engines receive the same ``translate`` arguments.
    """
    src, dst = [], []
    ranges = [(0x00C0, 0x024F), (0x0370, 0x03FF), (0x0400, 0x04FF), (0x1E00, 0x1EFF)]
    for lo, hi in ranges:
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            nfd = unicodedata.normalize("NFD", ch)
            base = "".join(c for c in nfd if unicodedata.category(c) != "Mn")
            base = unicodedata.normalize("NFC", base)
            if len(base) == 1 and base != ch and len(nfd) > 1:
                src.append(ch)
                dst.append(base)
    return "".join(src), "".join(dst)


ACCENT_FROM, ACCENT_TO = _accent_fold_pairs()


def sql_quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
