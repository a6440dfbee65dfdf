"""Accent stripping as a character translation table, generated from ``unicodedata``.

Rule: canonical decomposition (NFD), then drop combining marks (category Mn). Every BMP character
whose result is a single different character maps to it; characters whose result is empty (the
marks themselves) are deleted. Characters whose result has two or more characters (Hangul
syllables) are left alone, which Spark's ``translate`` cannot express; none occur in Latin text.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache


def strip_accents_py(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


@lru_cache(maxsize=1)
def strip_accents_translation() -> tuple[str, str]:
    mapped_src, mapped_dst, deleted = [], [], []
    for cp in range(0x80, 0x10000):
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3:
            continue
        ch = chr(cp)
        out = strip_accents_py(ch)
        if out == ch:
            continue
        if len(out) == 1:
            mapped_src.append(ch)
            mapped_dst.append(out)
        elif not out:
            deleted.append(ch)
    # translate() deletes source characters that have no counterpart, so deletions go last
    return "".join(mapped_src) + "".join(deleted), "".join(mapped_dst)
