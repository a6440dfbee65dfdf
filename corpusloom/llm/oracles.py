"""DuckDB SQL for the queries that SQL can express, over whole tables. It states each contract on its own:
plain pair scores, every rule on every url, positions from unnested words, one global running total."""

from __future__ import annotations

from .license_scan import BASE as PHRASES
from .license_scan import COVER, DECIDING, NOTICES, SHIFT, STRETCH
from .mixing import WEIGHTS
from .url_filter import BASE as URL_RULES
from .url_filter import PATTERNS

TOPK = """
WITH v AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, q FROM v WHERE vec_id % 20 = 0) a
  JOIN v b ON len(a.q) = len(b.q) AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs
QUALIFY rank <= 20
"""


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _url_sql() -> str:
    rows = []
    for verdict, host, path in URL_RULES:
        fits = f"(host = {_text(host)} OR suffix(host, {_text('.' + host)})) AND prefix(path, {_text(path)})"
        rows.append(f"SELECT page_id, url, host, path, 1 AS own, {_text(host + path)} AS rule, {_text(verdict)} AS verdict FROM u WHERE {fits}")
    for verdict, regex, _ in PATTERNS:
        rows.append(f"SELECT page_id, url, host, path, 0, {_text(regex)}, {_text(verdict)} FROM u WHERE regexp_matches(host || path, {_text(regex)})")
    return f"""
WITH u AS (
  SELECT row_number() OVER () AS n, page_id, url,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), fits AS (
  {" UNION ALL ".join(r.replace("SELECT page_id", "SELECT n, page_id", 1) for r in rows)}
), best AS (
  SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY n ORDER BY own DESC, length(rule) DESC, rule) = 1
)
SELECT u.page_id, u.host, u.path, CASE WHEN b.own = 1 THEN b.rule END AS rule, coalesce(b.verdict, 'allow') AS verdict
FROM u LEFT JOIN best b ON u.n = b.n
"""


def _license_sql() -> str:
    templates = ", ".join(f"({i}, {_text(label)}, {str(i < len(PHRASES)).lower()}, string_split({_text(phrase)}, ' '))"
                          for i, (phrase, label) in enumerate([*PHRASES, *NOTICES]))
    deciding = ", ".join(f"({len(PHRASES) + i}, [{', '.join(map(_text, entry.split('|')))}])"
                         for i, (phrase, _) in enumerate(NOTICES) for entry in DECIDING.get(phrase, []))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (
  SELECT *, len(w) - 1 AS n_grams FROM (VALUES {templates}) AS x(template, label, is_base, w)
), tg AS (
  SELECT template, label, is_base, n_grams, i - 1 AS tpos, w[i] || ' ' || w[i + 1] AS gram
  FROM (SELECT *, unnest(range(1, len(w))) AS i FROM t)
), dg AS (
  SELECT n, i - 1 AS pos, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT n, w, unnest(range(1, len(w))) AS i FROM d WHERE len(w) > 1)
), votes AS (
  SELECT n, template, label, is_base, n_grams, tpos, pos, pos - tpos AS diagonal FROM dg JOIN tg USING (gram)
), base AS (  -- a base phrase stands where all its grams vote on one diagonal
  SELECT n, label, true AS is_base, diagonal AS low, 1.0 AS cover FROM votes WHERE is_base
  GROUP BY n, template, label, diagonal, n_grams HAVING count(*) = n_grams
), places AS (  -- a notice may begin at any vote; its words then reach {STRETCH} times its length
  SELECT DISTINCT n, template, pos AS start, diagonal AS own, CAST(floor({STRETCH} * (n_grams + 1)) AS BIGINT) - 2 AS reach
  FROM votes WHERE NOT is_base
), inside AS (
  SELECT p.*, v.label, v.tpos, v.diagonal, v.n_grams FROM places p
  JOIN votes v ON v.n = p.n AND v.template = p.template AND v.pos BETWEEN p.start AND p.start + p.reach
), stepped AS (  -- diagonals in order; a step of more than {SHIFT} starts another chain
  SELECT n, template, start, own, diagonal,
         CASE WHEN diagonal - lag(diagonal) OVER w <= {SHIFT} THEN 0 ELSE 1 END AS fresh
  FROM (SELECT DISTINCT n, template, start, own, diagonal FROM inside)
  WINDOW w AS (PARTITION BY n, template, start, own ORDER BY diagonal)
), chains AS (
  SELECT *, sum(fresh) OVER (PARTITION BY n, template, start, own ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS chain FROM stepped
), linked AS (  -- the chain that holds the diagonal of the first vote
  SELECT i.n, i.template, i.label, i.start, i.own, i.n_grams, list(DISTINCT i.tpos) AS seen
  FROM inside i JOIN chains c USING (n, template, start, own, diagonal)
  JOIN chains o ON o.n = c.n AND o.template = c.template AND o.start = c.start AND o.own = c.own AND o.diagonal = c.own AND o.chain = c.chain
  GROUP BY i.n, i.template, i.label, i.start, i.own, i.n_grams
), asked AS (
  SELECT * FROM (VALUES {deciding}) AS x(template, grams)
), undecided AS (  -- spans that lack one of their deciding grams
  SELECT DISTINCT l.n, l.template, l.start, l.own
  FROM linked l JOIN asked a USING (template)
  WHERE NOT list_has_any(l.seen, (SELECT list(tpos) FROM tg WHERE tg.template = a.template AND list_contains(a.grams, tg.gram)))
), good AS (
  SELECT n, label, is_base, low, cover FROM base
  UNION ALL
  SELECT n, label, false, start, len(seen) / n_grams FROM linked l
  WHERE len(seen) / n_grams >= {COVER} AND NOT EXISTS (FROM undecided u WHERE u.n = l.n AND u.template = l.template AND u.start = l.start AND u.own = l.own)
), found AS (
  SELECT n, count(*) FILTER (is_base) AS n_base, min(low) FILTER (is_base) AS first_word, max(low) FILTER (is_base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
         max(cover) AS score
  FROM good GROUP BY n
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN found f ON d.n = f.n
"""


def _mixing_sql(passes: int = 3, seed: int = 7) -> str:
    weights = "[" + ", ".join(f"{w}" for w in WEIGHTS) + "]"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(text, '')) AS digest
  FROM documents
), turned AS (
  SELECT *, md5(concat_ws('|', '{seed}', coalesce(CAST(doc_id AS VARCHAR), ''), digest, coalesce(source, ''))) AS turn FROM d
), per AS (
  SELECT source, sum(size) AS source_size FROM d GROUP BY source
), weighed AS (
  SELECT *, {weights}[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight, {passes}.0 * source_size AS most FROM per
), ordered AS (
  SELECT *, most / weight AS full_at, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS place FROM weighed
), levels AS (  -- the level if exactly the first (place - 1) sources are full
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(most) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ordered
), chosen AS (
  SELECT level FROM levels WHERE full_at > level ORDER BY place LIMIT 1
), sources AS (
  SELECT w.*, least(most, weight * coalesce((SELECT level FROM chosen), 0)) AS target FROM weighed w
), ends AS (
  SELECT t.*, s.source_size, s.weight, s.target,
         sum(t.size) OVER (PARTITION BY t.source ORDER BY t.turn, t.doc_id, t.digest ROWS UNBOUNDED PRECEDING) AS final
  FROM turned t JOIN sources s ON t.source IS NOT DISTINCT FROM s.source
), offers AS (
  SELECT n, size, source, doc_id, digest, pass, (pass * source_size + final) / weight AS finish FROM ends, range({passes}) AS p(pass) WHERE size > 0
), taken AS (
  SELECT n, size, sum(size) OVER (ORDER BY finish, source NULLS LAST, doc_id, digest, pass, n ROWS UNBOUNDED PRECEDING) AS so_far FROM offers
), copies AS (
  SELECT n, sum(size) AS taken FROM taken WHERE so_far <= (SELECT sum(size) FROM d) GROUP BY n
)
SELECT e.doc_id, e.size, CAST(e.source_size AS BIGINT) AS source_size, e.target, CAST(coalesce(c.taken, 0) AS BIGINT) AS taken
FROM ends e LEFT JOIN copies c ON e.n = c.n
"""


ORACLE = {
    "op2_license_scan": _license_sql(),
    "op4_bsi_topk": TOPK,
    "op5_url_filter": _url_sql(),
    "op10_mixing": _mixing_sql(),
}
