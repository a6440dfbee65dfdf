"""DuckDB CTEs for the evaluation and preparation fixtures (mirrors ``plans.evaluation``)."""

from __future__ import annotations

from .. import constants as K
from . import oracle_sql as O
from .evaluation import COMPARED, SURVEY_CATEGORIES


def clean(expr: str) -> str:
    out = expr
    for pattern, repl in K.CLEANUP_STEPS:
        out = f"regexp_replace({out}, {O.sql_str(O.re2(pattern))}, {O.sql_str(repl)}, 'g')"
    return O.strip_ws(out)


def md5_unit(key_sql: str) -> str:
    return f"(CAST(('0x' || substr(md5({key_sql}), 1, 8)) AS BIGINT) / 4294967296.0)"


def raw_cosine(a: str, b: str) -> str:
    return (f"(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * "
            f"sqrt(list_dot_product({b}, {b}))))")


def cosine(a: str, b: str) -> str:
    return f"round({raw_cosine(a, b)}, 6)"


def _registry_values() -> str:
    rows = []
    for m in K.MODEL_REGISTRY:
        lm = "MAP {" + ", ".join(f"{O.sql_str(k)}: {O.sql_str(v)}" for k, v in m["language_map"].items()) + "}"
        restrict = O.sql_str(m["restrict_source_language"]) if m["restrict_source_language"] else "NULL"
        rows.append(f"({O.sql_str(m['model'])}, {O.sql_str(m['model_id'])}, {lm}, {restrict}, "
                    f"{m['batch_size']}, {m['grad_accum']}, "
                    f"CAST({O.sql_list(m['lr_grid'])} AS DOUBLE[]), CAST({O.sql_list(m['r_grid'])} AS INTEGER[]), "
                    f"CAST({O.sql_list(m['dropout_grid'])} AS DOUBLE[]))")
    return ("SELECT * FROM (VALUES " + ", ".join(rows) + ") t(model, model_id, language_map, "
            "restrict_source_language, batch_size, grad_accum, lr_grid, r_grid, dropout_grid)")


def _translator_values() -> str:
    rows = []
    for t in K.TRANSLATORS:
        vals = [O.sql_str(t[f]) if t[f] is not None else "CAST(NULL AS VARCHAR)"
                for f in ("translator_name", "family", "base_model_id", "merged_model_path",
                          "merged_model_path_en_fr", "merged_model_path_fr_en")]
        rows.append("(" + ", ".join(vals) + ")")
    return ("SELECT * FROM (VALUES " + ", ".join(rows) + ") t(translator_name, family, base_model_id, "
            "merged_model_path, merged_model_path_en_fr, merged_model_path_fr_en)")


def eval_chain() -> str:
    compared = ", ".join(f"({k}, {O.sql_str(n)})" for k, n in enumerate(COMPARED))
    cats = "[" + ", ".join(O.sql_str(c) if c else "NULL" for c in SURVEY_CATEGORIES) + "]"
    survey_cols = ", ".join(f"{cats}[(pair_id * {k + 2}) % 7 + 1] AS {n}" for k, n in enumerate(COMPARED))
    return f"""
corpus AS (
  SELECT pair_id, 0 AS direction, en AS source, fr AS target, 'en' AS source_lang, pair_id * 2 AS record_id FROM pairs
  UNION ALL
  SELECT pair_id, 1 AS direction, fr AS source, en AS target, 'fr' AS source_lang, pair_id * 2 + 1 AS record_id
  FROM pairs),
split_corpus AS (
  SELECT *, CASE WHEN {md5_unit("'42:' || CAST(record_id AS VARCHAR)")} < 0.05 THEN 'eval' ELSE 'train' END AS split
  FROM corpus),
registry AS ({_registry_values()}),
translators AS ({_translator_values()}),
restricted AS (
  SELECT s.*, r.model FROM split_corpus s JOIN registry r
    ON r.restrict_source_language IS NULL OR s.source_lang = r.restrict_source_language),
valid AS (SELECT * FROM restricted WHERE length({O.strip_ws('target')}) > 0),
sizes AS (
  SELECT r.model,
    CAST(count(CASE WHEN v.split = 'train' THEN 1 END) AS BIGINT) AS train_rows,
    CAST(count(CASE WHEN v.split = 'eval' THEN 1 END) AS BIGINT) AS eval_rows,
    CAST(ceil(count(CASE WHEN v.split = 'train' THEN 1 END) / CAST(r.batch_size * r.grad_accum AS DOUBLE)) AS BIGINT)
      AS steps_per_epoch,
    CAST(coalesce(sum(CASE WHEN v.split = 'train' THEN length(v.source) END), 0) AS BIGINT) AS train_chars,
    CAST(coalesce(sum(CASE WHEN v.split = 'eval' THEN length(v.source) END), 0) AS BIGINT) AS eval_chars
  FROM registry r LEFT JOIN valid v ON r.model = v.model GROUP BY r.model, r.batch_size, r.grad_accum),
g_lr AS (SELECT model, unnest(lr_grid) AS lr, unnest(range(len(lr_grid))) AS lr_index FROM registry),
g_r AS (SELECT model, unnest(r_grid) AS lora_r, unnest(range(len(r_grid))) AS r_index FROM registry),
g_d AS (SELECT model, unnest(dropout_grid) AS lora_dropout, unnest(range(len(dropout_grid))) AS d_index FROM registry),
grid AS (
  SELECT g_lr.model, lr_index, lr, r_index, lora_r, d_index, lora_dropout,
         CAST(floor(2.0 * lora_r) AS INTEGER) AS lora_alpha
  FROM g_lr JOIN g_r ON g_lr.model = g_r.model JOIN g_d ON g_lr.model = g_d.model),
sweep AS (
  SELECT g.model,
    g.model || '_auto/lr' || CAST(lr_index AS VARCHAR) || '_r' || CAST(lora_r AS VARCHAR) || '_a'
      || CAST(lora_alpha AS VARCHAR) || '_d' || CAST(d_index AS VARCHAR) AS trial_dir,
    lr, lora_r, lora_alpha, lora_dropout, least(s.train_rows, {K.SWEEP_TRAIN_SAMPLES}) AS train_samples,
    least(s.eval_rows, {K.SWEEP_EVAL_SAMPLES}) AS eval_samples,
    CAST((s.train_chars * (lr_index + 1) + s.train_rows * lora_r) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS final_train_loss,
    CASE WHEN lr_index = 0 AND r_index = 0 THEN CAST(NULL AS DOUBLE)
         ELSE CAST((s.eval_chars * (lr_index + 1) + s.eval_rows * lora_r) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS final_eval_loss
  FROM grid g JOIN sizes s ON g.model = s.model),
emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
nvec AS (SELECT count(*) AS n_vec FROM embeddings),
compared AS (SELECT * FROM (VALUES {compared}) t(translator_index, translator_name)),
comparison AS (
  SELECT p.pair_id, p.en AS source, p.fr AS target, 'en' AS source_lang, 'fr' AS other_lang, c.translator_name,
    CASE WHEN suffix(c.translator_name, '_finetuned') THEN {clean('p.fr')} ELSE p.fr END AS translated_text,
    {cosine('s.vec', 't.vec')} AS cosine_similarity_original_translation,
    {cosine('s.vec', 'x.vec')} AS cosine_similarity_vs_source,
    {cosine('t.vec', 'x.vec')} AS cosine_similarity_vs_target
  FROM pairs p CROSS JOIN nvec CROSS JOIN compared c
  JOIN emb s ON s.vec_id = p.pair_id % nvec.n_vec
  JOIN emb t ON t.vec_id = (p.pair_id * 7 + 1) % nvec.n_vec
  JOIN emb x ON x.vec_id = (p.pair_id * 13 + c.translator_index) % nvec.n_vec),
survey AS (
  SELECT fr AS source, CASE WHEN pair_id % 2 = 0 THEN 'train' ELSE 'test' END AS corpus_type, {survey_cols}
  FROM pairs)
"""


def with_all(select: str, extra: str = "") -> str:
    ctes = O.chain().strip() + ",\n" + eval_chain().strip()
    if extra.strip():
        ctes += ",\n" + extra.strip()
    return "WITH " + ctes + "\n" + select.strip()
