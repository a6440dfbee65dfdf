"""Row-local text expressions: every function maps Columns to a Column and stays JVM-side.

Java regex needs two flags to read a pattern the way Python does: ``U`` (Unicode classes for
``\\s \\d \\w \\b`` and Unicode case folding) and ``d`` (only ``\\n`` ends a line). ``i`` adds case
folding where the original pattern ignored case.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .accents import strip_accents_translation


# Python's whitespace: Java's (?U)\s and the information separators U+001C..U+001F. Written out, as Java asks a
# property for each character of a (?U) class
PY_WS_CHARS = "".join(map(chr, [*range(0x09, 0x0e), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b),
                                0x2028, 0x2029, 0x202f, 0x205f, 0x3000]))
_WS_BUT_SPACE = r"\t-\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PY_WS = rf"[ {_WS_BUT_SPACE}]"
# what Java's (?iU) takes for a letter besides its two cases
_FOLDS = {"i": "\u0130\u0131", "s": "\u017f", "k": "\u212a"}


def python_ws(pattern: str) -> str:
    r"""Rewrite ``\s`` (used outside character classes in our patterns) as Python's whitespace set."""
    return pattern.replace(r"\s", PY_WS)


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    return "(?dU)" + python_ws(either_case(pattern) if ignore_case else pattern)


def either_case(pattern: str) -> str:
    """The pattern with every letter as a class of its cases: what ``(?iU)`` matches, without folding each character
    of the text. Of letters in a class only the range A-Za-z is known."""
    def both(m: re.Match) -> str:
        found = m.group(0)
        if found[0] == "[":
            return found.replace("A-Za-z", "A-Za-z" + "".join(_FOLDS.values()))
        return f"[{found.lower()}{found.upper()}{_FOLDS.get(found.lower(), '')}]" if len(found) == 1 and found.isalpha() else found
    return re.sub(r"\\.|\[[^\]]*\]|.", both, pattern)


def one_of(words: Iterable[str]) -> str:
    """A pattern of any of ``words`` that tries a common beginning once."""
    after: dict[str, list[str]] = {}
    for w in words:
        after.setdefault(w[:1], []).append(w[1:])
    ends = after.pop("", None) is not None
    ways = "|".join(c + (one_of(rest) if any(rest) else "") for c, rest in sorted(after.items()))
    return f"(?:{ways}){'?' if ends else ''}"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- whitespace -------------------------------------------------------------------------------

def py_strip(c) -> Column:
    """Strip Unicode whitespace at both ends (Spark's trim only strips U+0020)."""
    return F.btrim(_col(c), F.lit(PY_WS_CHARS))


def whitespace_tokens(c) -> Column:
    """Whitespace split with empty tokens dropped: the same tokens as Python's ``str.split()``."""
    # a split at one plain character needs no pattern, which Spark would compile for each row
    return F.array_remove(F.split(F.regexp_replace(_col(c), f"[{_WS_BUT_SPACE}]", " "), " "), "")


# --- counts and ratios (ops 12-17, 19, 20) -----------------------------------------------------

def len_ratio(num, den) -> Column:
    """characters(num) / characters(den); NULL instead of an error when den is empty."""
    return F.try_divide(F.length(_col(num)).cast("double"), F.length(_col(den)).cast("double"))


def clause_count(c) -> Column:
    return char_occurrences(c, ",") + char_occurrences(c, ";") + F.lit(1)


def clause_ratio(fr, en) -> Column:
    return F.try_divide(clause_count(fr).cast("double"), clause_count(en).cast("double"))


def add_one_ratio(count_fr, count_en) -> Column:
    """(count_fr + 1) / (count_en + 1), the smoothing used for verb, noun and entity ratios."""
    return (_col(count_fr) + F.lit(1)).cast("double") / (_col(count_en) + F.lit(1)).cast("double")


def one_char_words(c, allow: Iterable[str]) -> Column:
    allowed = F.array(*[F.lit(a) for a in allow])
    return F.size(F.filter(whitespace_tokens(c),
                           lambda t: (F.length(t) == 1) & ~F.array_contains(allowed, t)))


def char_occurrences(c, ch: str) -> Column:
    return F.length(_col(c)) - F.length(F.replace(_col(c), F.lit(ch), F.lit("")))


# --- apostrophes (ops 21, 22) ------------------------------------------------------------------

def missing_apostrophe(c) -> Column:
    letters = "".join(sorted(set(x.upper() for x in K.APOSTROPHE_LETTERS), key=K.APOSTROPHE_LETTERS.index))
    return F.coalesce(_col(c).rlike(f"(?i)(^| )[{letters}] "), F.lit(False))


def repair_apostrophes(c) -> Column:
    """The 24 replacements, one after another; a single combined regex gives different text."""
    # a text in which no letter stands so is left as it is by every one of them
    needed = _col(c).rlike(f"(?:^| )[{''.join(K.APOSTROPHE_LETTERS)}] ")
    out = _col(c)
    for letter in K.APOSTROPHE_LETTERS:
        out = F.replace(out, F.lit(f" {letter} "), F.lit(f" {letter}'"))
        out = F.regexp_replace(out, f"^{letter} ", f"{letter}'")
    return F.when(needed, out).otherwise(_col(c))


# --- accents (ops 23-26) -------------------------------------------------------------------------

def has_non_ascii(c) -> Column:
    return _col(c).rlike(r"[^\x00-\x7F]")


def strip_accents(c) -> Column:
    """NFD then drop combining marks, as one ``translate`` over a table generated from unicodedata."""
    src, dst = strip_accents_translation()
    return F.translate(_col(c), src, dst)


def accented_token_list(c) -> Column:
    """Whitespace tokens without parentheses that are all letters and not pure ASCII, lower-cased."""
    accented = F.filter(whitespace_tokens(c), lambda t: F.octet_length(t) > F.length(t))
    cleaned = F.transform(accented, lambda t: F.replace(F.replace(t, F.lit("("), F.lit("")), F.lit(")"), F.lit("")))
    kept = F.filter(cleaned, lambda t: t.rlike(r"(?d)^\p{L}+$"))
    return F.transform(kept, lambda t: F.lower(t))


WORD_RUNS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"


def replace_words(c, mapping: Column) -> Column:
    """Whole-word dictionary replacement: split into word / non-word runs, look words up, re-join."""
    runs = F.regexp_extract_all(_col(c), F.lit(WORD_RUNS), 0)
    return F.array_join(F.transform(runs, lambda t: F.coalesce(F.try_element_at(mapping, t), t)), "")


# --- figure text and dates (ops 28-31) -------------------------------------------------------------

def figtext_flags(c, lang: str) -> dict[str, Column]:
    text = _col(c)
    # patterns for a text's end are tried where its last characters allow them
    body = F.rtrim(text, F.lit(PY_WS_CHARS))
    flags = {
        "has_trailing_numbers": F.coalesce(F.right(body, F.lit(1)).rlike(r"(?U)\d")
                                           & text.rlike(java_regex(K.TRAILING_NUMBER_PATTERN)), F.lit(False)),
        "has_parenthetical_numbers": F.coalesce(body.endswith(")") & text.rlike(java_regex(K.PARENTHETICAL_NUMBER_PATTERN)),
                                                F.lit(False)),
        # blanks before a reference, which may be none, decide nothing
        "has_figure_references": F.coalesce(text.rlike(java_regex(K.FIGURE_REFERENCE_PATTERN[lang].removeprefix(r"\s*"), True)),
                                            F.lit(False)),
        "has_repeated_punctuation": F.coalesce(F.right(text, F.lit(3)).rlike(java_regex(K.REPEATED_PUNCTUATION_PATTERN)),
                                               F.lit(False)),
    }
    flags["exclude_figtext"] = (flags["has_figure_references"] | flags["has_trailing_numbers"]
                                | flags["has_parenthetical_numbers"] | flags["has_repeated_punctuation"])
    return flags


def has_date_refs(*cols) -> Column:
    year, months = K.DATE_PATTERN.split("|(?:", 1)
    names = {m.lower() for m in months.removesuffix(r")\b").split("|")}
    # the first characters are looked at before the word boundary and the names, which are dearer
    begin = "".join(f"[{''.join(sorted(either_case(''.join({n[i] for n in names})).translate({91: None, 93: None})))}]" for i in range(3))
    pattern = java_regex(rf"(?=[12]){year}|(?={begin}){one_of(names)}\b", True)
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(_col(c).rlike(pattern), F.lit(False))
    return out


# --- clean-up, prompts, responses (ops 32-35) ------------------------------------------------------

def append_period(c) -> Column:
    return F.concat(_col(c), F.lit("."))


def _sooner(pattern: str) -> str:
    """The pattern with its possible first characters looked at before a word boundary, which is dearer; a single
    space, which is what it would be replaced by, is no match of blanks."""
    if pattern == r"\s+":
        return rf"{PY_WS}{{2,}}|[{_WS_BUT_SPACE}]"
    first = {r"\(?\b(F": "(?=[(FfTt])", r"\b(DFO|MPO)": "(?=[DM])"}
    return next((look for start, look in first.items() if pattern.startswith(start)), "") + pattern


def clean_common_patterns(c) -> Column:
    out = _col(c).cast("string")
    for pattern, repl in K.CLEANUP_STEPS:
        icase = pattern.startswith("(?i)")
        out = F.regexp_replace(out, java_regex(_sooner(pattern[4:] if icase else pattern), icase), repl)
    return py_strip(out)


def build_prompt(text, lang) -> Column:
    en_prompt = K.PROMPT_TEMPLATE_EN.format(instruction=K.INSTRUCTION_EN, text="%s")
    fr_prompt = K.PROMPT_TEMPLATE_FR.format(instruction=K.INSTRUCTION_FR, text="%s")
    filled = F.when(F.lower(_col(lang)).startswith("en"), F.format_string(en_prompt, _col(text))) \
              .otherwise(F.format_string(fr_prompt, _col(text)))
    return F.when(_col(text).isNotNull(), filled)


def extract_response(generated, prompt) -> Column:
    """Text after the first response marker, else the text with the prompt removed; first line, stripped."""
    gen = _col(generated)
    marker = K.RESPONSE_MARKER
    pos = F.instr(gen, marker)
    after = F.substr(gen, pos + F.lit(len(marker)))
    body = F.when(pos > 0, after).otherwise(F.replace(gen, _col(prompt), F.lit("")))
    first_line = F.split(py_strip(body), "\n").getItem(0)
    return py_strip(first_line)


# --- vectors (op 40) ----------------------------------------------------------------------------------

def dot(a, b) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a, b, digits: int = 6) -> Column:
    return cosine_from_norms(a, b, norm(a), norm(b), digits)


def cosine_from_norms(a, b, norm_a, norm_b, digits: int | None = 6) -> Column:
    """Cosine with the norms computed once per vector (e.g. per embedding row) instead of per pair;
    unrounded without ``digits`` (decisions compare raw values)."""
    raw = F.try_divide(dot(a, b), _col(norm_a) * _col(norm_b))
    return raw if digits is None else F.round(raw, digits)
