"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

The driver pre-registers the parquet tables as views. Everything the Spark side derives
(pairs, features, the accent map, the gate) is restated here as a chain of CTEs, so each oracle
query is ``WITH <chain> SELECT ...``. Regex notes for RE2: ``\\s`` and ``\\b`` are ASCII-only, so
whitespace is written as an explicit class; never use ``(?U)`` (it means "ungreedy" in RE2).
"""

from __future__ import annotations

from .. import constants as K

WS = r"[\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_str(v) if isinstance(v, str) else repr(v) for v in values) + "]"


def tokens(expr: str) -> str:
    """Whitespace tokens with empty ones dropped (Python ``str.split()``)."""
    return f"list_filter(regexp_split_to_array({expr}, '{WS}+'), lambda t: t <> '')"


def strip_ws(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def one_char_words(expr: str, allow) -> str:
    return (f"len(list_filter({tokens(expr)}, lambda t: length(t) = 1 AND NOT list_contains("
            f"{sql_list(allow)}, t)))")


def repair_apostrophes(expr: str) -> str:
    out = expr
    for letter in K.APOSTROPHE_LETTERS:
        out = f"regexp_replace({out}, ' {letter} ', ' {letter}''', 'g')"
        out = f"regexp_replace({out}, '^{letter} ', '{letter}''')"
    return out


def re2(pattern: str) -> str:
    """Python pattern -> RE2 pattern: explicit Unicode whitespace and digits."""
    return pattern.replace(r"\s", WS).replace(r"\d", r"\p{Nd}")


def figtext(expr: str, lang: str) -> dict[str, str]:
    f = {
        "has_trailing_numbers": f"coalesce(regexp_matches({expr}, {sql_str(re2(K.TRAILING_NUMBER_PATTERN))}), false)",
        "has_parenthetical_numbers":
            f"coalesce(regexp_matches({expr}, {sql_str(re2(K.PARENTHETICAL_NUMBER_PATTERN))}), false)",
        "has_figure_references":
            f"coalesce(regexp_matches({expr}, {sql_str('(?i)' + re2(K.FIGURE_REFERENCE_PATTERN[lang]))}), false)",
        "has_repeated_punctuation":
            f"coalesce(regexp_matches({expr}, {sql_str(re2(K.REPEATED_PUNCTUATION_PATTERN))}), false)",
    }
    f["exclude_figtext"] = "(" + " OR ".join(f.values()) + ")"
    return f


def date_refs(*exprs: str) -> str:
    pat = sql_str("(?i)" + re2(K.DATE_PATTERN))
    return "(" + " OR ".join(f"coalesce(regexp_matches({e}, {pat}), false)" for e in exprs) + ")"


def clause_count(expr: str) -> str:
    return f"(len(regexp_extract_all({expr}, '[,;]')) + 1)"


VERB_RE = r"(ing|ed|er)([ .,;!?]|$)"
NOUN_RE = r"(tion|ment|ness)([ .,;!?]|$)"
ENTITY_RE = r"(^| )[A-Z][a-z]+"


def rcount(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {sql_str(pattern)}))"


WORD_RUNS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"


NBSP = " "


def _inject_en(e: str) -> str:
    return (f"CASE pair_id % 16 WHEN 0 THEN {e} || ' 12' WHEN 1 THEN {e} || ' (3)' "
            f"WHEN 2 THEN {e} || ' see Figure 4 here' WHEN 4 THEN {e} || ' in 1998 only' "
            f"WHEN 5 THEN {e} || ' it may' WHEN 11 THEN {e} || ' x y z' ELSE {e} END")


def _inject_fr(f: str) -> str:
    return (f"CASE pair_id % 16 WHEN 3 THEN {f} || '!!' WHEN 6 THEN 'L ' || {f} "
            f"WHEN 7 THEN {f} || ' a l D eau' WHEN 8 THEN strip_accents({f}) "
            f"WHEN 9 THEN {f} || ' Tableau{NBSP}5' WHEN 10 THEN {f} || ' l’eau' "
            f"WHEN 12 THEN {f} || ', a; b, c; d' WHEN 13 THEN {f} || ' FÉVRIER' ELSE {f} END")


def _inject_odd_fr(f: str) -> str:
    return (f"CASE pair_id % 97 WHEN 29 THEN CAST(NULL AS VARCHAR) WHEN 43 THEN '' WHEN 59 THEN '  ' || ({f}) || ' ' || chr(9) "
            f"WHEN 83 THEN ({f}) || repeat(' mot', 600) ELSE ({f}) END")


def _gate_columns() -> str:
    tier = ("CASE WHEN similarity < 0.85 THEN 's1' WHEN similarity >= 0.85 AND similarity < 0.92 THEN 's2' "
            "WHEN similarity >= 0.92 THEN 's3' END")
    parts = [f"coalesce(similarity < {K.LOW_SIMILARITY}, false) AS exclude_low_similarity"]
    for feat in K.FEATURES:
        whens = " ".join(
            f"WHEN {tier} = '{t}' THEN NOT coalesce({feat} BETWEEN {K.OUTLIER_CRITERIA[t][feat][0]} AND "
            f"{K.OUTLIER_CRITERIA[t][feat][1]}, false)" for t in ("s1", "s2", "s3"))
        parts.append(f"CASE {whens} ELSE false END AS exclude_{feat}")
    en = figtext("en", "en")["exclude_figtext"]
    fr = figtext("fr", "fr")["exclude_figtext"]
    parts.append(f"({en} OR {fr}) AS exclude_figtext")
    parts.append(f"{date_refs('en', 'fr')} AS has_date_refs")
    for feat in K.RELAXED_FEATURES:
        lo, hi = K.OUTLIER_CRITERIA["s3"][feat]
        parts.append(f"NOT coalesce({feat} BETWEEN {lo} AND {hi}, false) AS exclude_relaxed_{feat}")
    return ",\n    ".join(parts)


def _exclude_expr() -> str:
    terms = []
    for c in K.EXCLUSION_COLUMNS:
        terms.append(f"coalesce({c} <> 0, false)" if c == "potential_fr_accent_issues" else f"coalesce({c}, false)")
    return " OR ".join(terms)


def chain(cutoff: int = K.ACCENT_MAP_SIZE) -> str:
    """CTE chain mirroring plans.curation (pairs -> features -> accent pass -> gate)."""
    relaxed = " OR ".join(f"exclude_relaxed_{f}" for f in K.RELAXED_FEATURES)
    return f"""
lines AS (
  SELECT doc_id, lang, line_no, line FROM (
    SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
           unnest(range(len(string_split(text, chr(10))))) AS line_no
    FROM documents WHERE lang IN ('en', 'fr') AND text IS NOT NULL)
  WHERE line <> ''),
numbered AS (
  SELECT lang, line, row_number() OVER (PARTITION BY lang ORDER BY doc_id, line_no) - 1 AS pair_id FROM lines),
n_lines AS (
  SELECT count(*) FILTER (lang = 'en') AS n_en, count(*) FILTER (lang = 'fr') AS n_fr FROM numbered),
pairs0 AS (
  SELECT e.pair_id, f.line AS fr0, e.line AS en0
  FROM (SELECT pair_id, line, pair_id % n_fr AS other FROM numbered, n_lines WHERE lang = 'en' AND n_en >= n_fr) e
  JOIN numbered f ON f.lang = 'fr' AND f.pair_id = e.other
  UNION ALL
  SELECT f.pair_id, f.line AS fr0, e.line AS en0
  FROM (SELECT pair_id, line, pair_id % n_en AS other FROM numbered, n_lines WHERE lang = 'fr' AND n_en < n_fr) f
  JOIN numbered e ON e.lang = 'en' AND e.pair_id = f.other),
pairs AS (
  SELECT pair_id, {_inject_odd_fr(_inject_fr('fr0'))} AS fr, {_inject_en('en0')} AS en,
         CASE WHEN pair_id % 97 <> 13 THEN CAST(70 + (pair_id * 37) % 31 AS DOUBLE) / CAST(100 AS DOUBLE) END AS similarity
  FROM pairs0),
feats AS (
  SELECT pair_id, fr AS fr_raw, en, similarity,
    CAST(length(fr) AS DOUBLE) / CAST(length(en) AS DOUBLE) AS len_ratio,
    CAST({rcount('fr', VERB_RE)} + 1 AS DOUBLE) / CAST({rcount('en', VERB_RE)} + 1 AS DOUBLE) AS verb_ratio,
    CAST({rcount('fr', NOUN_RE)} + 1 AS DOUBLE) / CAST({rcount('en', NOUN_RE)} + 1 AS DOUBLE) AS noun_ratio,
    CAST({rcount('fr', ENTITY_RE)} + 1 AS DOUBLE) / CAST({rcount('en', ENTITY_RE)} + 1 AS DOUBLE) AS entity_ratio,
    CAST({clause_count('fr')} AS DOUBLE) / CAST({clause_count('en')} AS DOUBLE) AS clause_ratio,
    CAST({one_char_words('fr', K.ONE_CHAR_ALLOW_FR)} AS BIGINT) AS one_char_words_fr,
    CAST({one_char_words('en', K.ONE_CHAR_ALLOW_EN)} AS BIGINT) AS one_char_words_en,
    {repair_apostrophes('fr')} AS fr_apos
  FROM pairs),
acc_tok AS (
  SELECT lower(w) AS accented FROM (
    SELECT unnest(list_filter(list_transform({tokens('fr_apos')}, lambda t: regexp_replace(t, '[()]', '', 'g')),
                  lambda t: regexp_matches(t, '^\\p{{L}}+$') AND regexp_matches(t, '[^\\x00-\\x7F]'))) AS w
    FROM feats)),
acc_counts AS (
  SELECT accented, count(*) AS count, strip_accents(accented) AS anglicised FROM acc_tok GROUP BY accented),
acc_map AS (
  SELECT *, count(*) OVER (PARTITION BY anglicised) AS n_forms,
         row_number() OVER (PARTITION BY anglicised ORDER BY count DESC, accented) AS form_rank
  FROM acc_counts),
lexicon AS (
  SELECT DISTINCT word FROM (SELECT unnest({tokens('text')}) AS word FROM documents WHERE lang = 'fr')
  WHERE regexp_matches(word, '^[a-z]+$') AND length(word) % 2 = 0),
lex_split AS (
  SELECT a.anglicised, a.accented, a.count, l.word IS NOT NULL AS in_lexicon
  FROM acc_map a LEFT JOIN lexicon l ON a.anglicised = l.word WHERE a.n_forms = 1),
vocab AS (
  SELECT anglicised, accented, count,
         row_number() OVER (ORDER BY count DESC, accented) AS vocab_rank
  FROM lex_split WHERE NOT in_lexicon),
vocab2 AS (SELECT *, vocab_rank <= {cutoff} AS in_map FROM vocab),
amap AS (
  SELECT map_from_entries(list(struct_pack(k := anglicised, v := accented))) AS m FROM vocab2 WHERE in_map),
uncommon AS (SELECT anglicised AS word FROM vocab2 WHERE NOT in_map),
repaired AS (
  SELECT f.*, array_to_string(list_transform(regexp_extract_all(f.fr_apos, {sql_str(WORD_RUNS)}),
                                             lambda t: coalesce(amap.m[t], t)), '') AS fr
  FROM feats f CROSS JOIN amap),
hits AS (
  SELECT r.pair_id, count(*) AS n FROM (SELECT pair_id, unnest({tokens('fr')}) AS w FROM repaired) r
  WHERE r.w IN (SELECT word FROM uncommon) GROUP BY r.pair_id),
features AS (
  SELECT r.*, CAST(coalesce(h.n, 0) AS BIGINT) AS potential_fr_accent_issues
  FROM repaired r LEFT JOIN hits h ON r.pair_id = h.pair_id),
gated0 AS (
  SELECT *, {_gate_columns()}
  FROM features),
gated AS (
  SELECT *, ({_exclude_expr()}) AS exclude, ({relaxed}) AS exclude_relaxed FROM gated0)
"""
