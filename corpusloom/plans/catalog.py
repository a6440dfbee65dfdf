"""Every operator of the inventory as a registered query ``(spark, sf_dir) -> DataFrame``, each with
its DuckDB oracle where one is expressible. Keys follow the inventory's names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..operators import accent as A
from ..operators import evalstats as E
from ..operators import gates as G
from ..operators import plugins as PL
from ..operators import prep as P
from ..operators import profile as PR
from ..operators import sampling as S
from ..operators import subword as SW
from ..operators.encoder import trigram_embeddings
from ..session import Scope, bucket_count, scratch_path
from ..sources import corpus as IO
from . import evaluation as EV
from . import oracle_sql as O
from .curation import annotate_counts, curation
from .oracle_eval import clean as sql_clean
from .oracle_eval import raw_cosine
from .oracle_eval import with_all

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def _c(spark, sf):
    return curation(spark, sf)


# ====================================== 2A sources and sinks ======================================

@register("read_pairs", with_all("SELECT pair_id, fr, en, similarity FROM pairs"))
def q_read_pairs(spark, sf):
    path = IO.write_pairs(_c(spark, sf).pairs(), scratch_path(spark, "pairs"))
    return IO.read_pairs(spark, path)


FEATURE_OUT = ["pair_id", "fr", "en", "similarity", "len_ratio", "verb_ratio", "noun_ratio", "entity_ratio",
               "clause_ratio", "one_char_words_fr", "one_char_words_en", "potential_fr_accent_issues"]


@register("write_pairs", with_all(f"SELECT {', '.join(FEATURE_OUT)} FROM features"))
def q_write_pairs(spark, sf):
    path = IO.write_pairs(_c(spark, sf).features().select(*FEATURE_OUT), scratch_path(spark, "features"))
    return spark.read.parquet(path)


@register("read_corpus", with_all("SELECT source, target, source_lang FROM corpus WHERE source IS NOT NULL AND target IS NOT NULL"))
def q_read_corpus(spark, sf):
    path = IO.write_corpus(EV.corpus(_c(spark, sf)), scratch_path(spark, "corpus"))
    return IO.read_corpus(spark, path)


@register("bidirectional_pairs", with_all("SELECT pair_id, direction, source, target, source_lang, record_id FROM corpus"))
def q_bidirectional(spark, sf):
    return P.bidirectional(_c(spark, sf).pairs())


TRAINING_SQL = """
SELECT pair_id, 0 AS direction, en || '.' AS source, fr || '.' AS target, 'en' AS source_lang FROM gated
WHERE NOT exclude AND fr IS NOT NULL AND en IS NOT NULL
UNION ALL
SELECT pair_id, 1 AS direction, fr || '.' AS source, en || '.' AS target, 'fr' AS source_lang FROM gated
WHERE NOT exclude AND fr IS NOT NULL AND en IS NOT NULL"""


@register("write_corpus", with_all(f"SELECT source, target, source_lang FROM ({TRAINING_SQL})"))
def q_write_corpus(spark, sf):
    recs = P.bidirectional(G.training_pairs(_c(spark, sf).gated()))
    path = IO.write_corpus(recs, scratch_path(spark, "training_data"))
    return IO.read_corpus(spark, path)


PROMPT_SQL = """
SELECT 'translate French to English: ' || fr || ' <sep> ' || en AS text FROM pairs WHERE fr IS NOT NULL AND en IS NOT NULL
UNION ALL
SELECT 'translate English to French: ' || en || ' <sep> ' || fr AS text FROM pairs WHERE fr IS NOT NULL AND en IS NOT NULL"""


@register("write_prompt_corpus", with_all(PROMPT_SQL))
def q_write_prompt_corpus(spark, sf):
    with Scope(spark):
        path = IO.write_prompt_corpus(_c(spark, sf).pairs_once(), scratch_path(spark, "prompts"))
    return spark.read.schema(IO.PROMPT_SCHEMA).json(path)


SWEEP_COLS = ["trial_dir", "lr", "lora_r", "lora_alpha", "lora_dropout", "train_samples", "eval_samples",
              "final_train_loss", "final_eval_loss"]


@register("read_scores", with_all(f"SELECT {', '.join(SWEEP_COLS)} FROM sweep"))
def q_read_scores(spark, sf):
    path = scratch_path(spark, "sweep_results")
    EV.sweep(_c(spark, sf)).select(*SWEEP_COLS).write.options(**IO.CSV_WRITE).csv(path)
    return IO.read_scores(spark, path, IO.SWEEP_SCHEMA)


COMPARISON_COLS = [f.name for f in IO.COMPARISON_SCHEMA.fields]


@register("write_comparison", with_all(f"SELECT {', '.join(COMPARISON_COLS)} FROM comparison"))
def q_write_comparison(spark, sf):
    path = IO.write_comparison(EV.comparison(_c(spark, sf)), scratch_path(spark, "comparison"), "20250101-0000")
    return IO.read_scores(spark, path, IO.COMPARISON_SCHEMA)


@register("append_sweep_results", with_all(f"SELECT {', '.join(SWEEP_COLS)}, model FROM sweep"))
def q_append_sweep(spark, sf):
    path = scratch_path(spark, "sweep_appended")
    trials = EV.sweep(_c(spark, sf))
    # a run appends per model; the second append lands beside the first
    first = [m["model"] for m in K.MODEL_REGISTRY[:2]]
    IO.append_sweep_results(trials.where(F.col("model").isin(first)), path, "run-1")
    IO.append_sweep_results(trials.where(~F.col("model").isin(first)), path, "run-2")
    IO.append_sweep_results(trials.where(F.col("model").isin(first)), path, "run-1")  # a retry
    return IO.read_sweep_results(spark, path).drop("run_id")


SINK_STATS_SQL = f"""
SELECT round(CAST(sum(strlen(CAST(to_json(struct_pack(source := source, target := target, source_lang := source_lang))
                                  AS VARCHAR)) + 1) AS DOUBLE) / 1024.0, 2) AS size_kb,
       CAST(count(*) AS BIGINT) AS line_count
FROM ({TRAINING_SQL})"""


@register("sink_stats", with_all(SINK_STATS_SQL))
def q_sink_stats(spark, sf):
    recs = P.bidirectional(G.training_pairs(_c(spark, sf).gated()))
    path = IO.write_corpus(recs, scratch_path(spark, "training_data"))
    return IO.sink_stats(spark, path)


REPORT_SQL = """
SELECT printf(chr(10) || '[%d/%d] %s' || chr(9) || 'text in' || chr(10) || chr(9) || '%s' || chr(10)
  || 'text out (expected)' || chr(10) || chr(9) || '%s' || chr(10) || 'text out (predicted with base model)'
  || chr(10) || chr(9) || '%s' || chr(10) || 'text out (predicted with finetuned model)' || chr(10) || chr(9)
  || '%s' || chr(10), sample_no, n_samples, source_lang, source, target, base_output, finetuned_output) AS value
FROM (
  SELECT CAST(b.pair_id + 1 AS INTEGER) AS sample_no, CAST((SELECT count(*) FROM pairs) AS INTEGER) AS n_samples,
         b.source_lang, b.source, b.target, b.translated_text AS base_output, f.translated_text AS finetuned_output
  FROM comparison b JOIN comparison f ON b.pair_id = f.pair_id
  WHERE b.translator_name = 'opus_mt_base' AND f.translator_name = 'opus_mt_finetuned'
    AND b.source IS NOT NULL AND b.target IS NOT NULL)"""


@register("comparison_report", with_all(REPORT_SQL))
def q_comparison_report(spark, sf):
    cmp_ = EV.comparison(_c(spark, sf))
    n_samples = cmp_.where(F.col("translator_name") == "opus_mt_base").count()
    base = cmp_.where(F.col("translator_name") == "opus_mt_base") \
               .select("pair_id", "source_lang", "source", "target", F.col("translated_text").alias("base_output"))
    fine = cmp_.where(F.col("translator_name") == "opus_mt_finetuned") \
               .select("pair_id", F.col("translated_text").alias("finetuned_output"))
    samples = (base.join(fine, "pair_id").where("source IS NOT NULL AND target IS NOT NULL")
                   .withColumns({"sample_no": (F.col("pair_id") + 1).cast("int"),
                                 "n_samples": F.lit(n_samples).cast("int")}))
    path = IO.write_report(IO.comparison_report(samples), scratch_path(spark, "report"))
    return IO.read_report(spark, path)


# =================================== 2B scalar / text projections ===================================

@register("len_ratio", with_all("SELECT pair_id, len_ratio FROM feats"))
def q_len_ratio(spark, sf):
    return _c(spark, sf).features_pre().select("pair_id", "len_ratio")


@register("len_ratio_reverse",
          with_all("SELECT pair_id, CAST(length(en) AS DOUBLE) / nullif(CAST(length(fr) AS DOUBLE), 0) AS len_ratio_reverse "
                   "FROM pairs"))
def q_len_ratio_reverse(spark, sf):
    return _c(spark, sf).pairs().select("pair_id", T.len_ratio("en", "fr").alias("len_ratio_reverse"))


@register("clause_ratio", with_all("SELECT pair_id, clause_ratio FROM feats"))
def q_clause_ratio(spark, sf):
    return _c(spark, sf).features_pre().select("pair_id", "clause_ratio")


@register("verb_ratio", with_all("SELECT pair_id, verb_ratio FROM feats"))
def q_verb_ratio(spark, sf):
    return _c(spark, sf).features_pre().select("pair_id", "verb_ratio")


@register("noun_ratio", with_all("SELECT pair_id, noun_ratio FROM feats"))
def q_noun_ratio(spark, sf):
    return _c(spark, sf).features_pre().select("pair_id", "noun_ratio")


@register("entity_ratio", with_all("SELECT pair_id, entity_ratio FROM feats"))
def q_entity_ratio(spark, sf):
    return _c(spark, sf).features_pre().select("pair_id", "entity_ratio")


def _annot_sql() -> str:
    cols = []
    for lang in ("fr", "en"):
        for name, pat in (("verbs", O.VERB_RE), ("nouns", O.NOUN_RE), ("entities", O.ENTITY_RE)):
            cols.append(f"CAST({O.rcount(lang, pat)} AS BIGINT) AS {name}_{lang}")
    return "SELECT pair_id, " + ", ".join(cols) + " FROM pairs"


@register("annotate_counts", with_all(_annot_sql()))
def q_annotate_counts(spark, sf):
    cols = [f"{n}_{lang}" for lang in ("fr", "en") for n in ("verbs", "nouns", "entities")]
    return annotate_counts(_c(spark, sf).pairs()).select("pair_id", *cols)


@register("tagger_counts")
def q_tagger_counts(spark, sf):
    """Op 18 by the learned tagger: Baum-Welch over both sides of all pairs, then Viterbi over each."""
    return curation(spark, sf, tagger="learn").counts()


@register("tagger_gate")
def q_tagger_gate(spark, sf):
    """Ops 15-17 and 45 on the learned tagger's counts: the ratios, and whether the pair passes the training gate."""
    c = curation(spark, sf, tagger="learn")
    passed = G.training_pairs(c.gated()).select("pair_id", F.lit(True).alias("passed"))
    return c.features_pre().select("pair_id", "verb_ratio", "noun_ratio", "entity_ratio").join(passed, "pair_id", "left") \
            .na.fill(False, ["passed"])


@register("one_char_words", with_all("SELECT pair_id, one_char_words_fr, one_char_words_en FROM feats"))
def q_one_char_words(spark, sf):
    return _c(spark, sf).features_pre().select("pair_id", "one_char_words_fr", "one_char_words_en")


@register("apostrophe_variants", with_all(
    "SELECT pair_id, CAST(len(regexp_extract_all(fr, '''')) AS BIGINT) AS n_straight, "
    "CAST(len(regexp_extract_all(fr, '’')) AS BIGINT) AS n_curved FROM pairs"))
def q_apostrophe_variants(spark, sf):
    return _c(spark, sf).pairs().select(
        "pair_id", T.char_occurrences("fr", K.STRAIGHT_APOSTROPHE).cast("long").alias("n_straight"),
        T.char_occurrences("fr", K.CURVED_APOSTROPHE).cast("long").alias("n_curved"))


@register("missing_apostrophe", with_all(
    "SELECT pair_id, coalesce(regexp_matches(fr, '(?i)(^| )[LDNMST] '), false) AS missing_apostrophe FROM pairs"))
def q_missing_apostrophe(spark, sf):
    return _c(spark, sf).pairs().select("pair_id", T.missing_apostrophe("fr").alias("missing_apostrophe"))


@register("repair_apostrophes", with_all("SELECT pair_id, fr_apos AS fr FROM feats"))
def q_repair_apostrophes(spark, sf):
    return _c(spark, sf).pairs().select("pair_id", T.repair_apostrophes(F.col("fr")).alias("fr"))


@register("non_ascii_word", with_all(
    f"SELECT pair_id, CAST(len({O.tokens('fr')}) AS BIGINT) AS n_words, "
    f"CAST(len(list_filter({O.tokens('fr')}, lambda t: regexp_matches(t, '[^\\x00-\\x7F]'))) AS BIGINT) "
    f"AS n_non_ascii_words FROM pairs"))
def q_non_ascii_word(spark, sf):
    toks = T.whitespace_tokens("fr")
    return _c(spark, sf).pairs().select(
        "pair_id", F.size(toks).cast("long").alias("n_words"),
        F.size(F.filter(toks, lambda t: T.has_non_ascii(t))).cast("long").alias("n_non_ascii_words"))


@register("strip_accents", with_all("SELECT pair_id, strip_accents(fr) AS fr_stripped FROM pairs"))
def q_strip_accents(spark, sf):
    return _c(spark, sf).pairs().select("pair_id", T.strip_accents("fr").alias("fr_stripped"))


ACC_TOK_SQL = f"""
SELECT pair_id, CAST(token_pos AS INTEGER) AS token_pos, lower(w) AS accented FROM (
  SELECT pair_id, unnest(l) AS w, unnest(range(len(l))) AS token_pos FROM (
    SELECT pair_id, list_filter(list_transform({O.tokens('fr_apos')}, lambda t: regexp_replace(t, '[()]', '', 'g')),
       lambda t: regexp_matches(t, '^\\p{{L}}+$') AND regexp_matches(t, '[^\\x00-\\x7F]')) AS l FROM feats))"""


@register("accented_tokens", with_all(ACC_TOK_SQL))
def q_accented_tokens(spark, sf):
    return A.accented_tokens(_c(spark, sf).features_pre(), "fr_apos")


@register("replace_words", with_all("SELECT pair_id, fr FROM features"))
def q_replace_words(spark, sf):
    return _c(spark, sf).features_core().select("pair_id", "fr")


def _hits(list_cte: str) -> str:
    return (f"(SELECT CAST(count(*) AS BIGINT) FROM (SELECT unnest({O.tokens('f.fr')}) AS w) t "
            f"WHERE t.w IN (SELECT word FROM {list_cte}))")


TOKEN_HITS_SQL = f"""
SELECT f.pair_id, {_hits('ambiguous')} AS ambiguous_hits, {_hits('real_words')} AS real_word_hits,
  f.potential_fr_accent_issues AS uncommon_hits
FROM features f"""
TOKEN_HITS_CTES = """
ambiguous AS (SELECT DISTINCT anglicised AS word FROM acc_map WHERE form_rank > 1),
real_words AS (SELECT anglicised AS word FROM lex_split WHERE in_lexicon)"""


@register("token_list_hits", with_all(TOKEN_HITS_SQL, TOKEN_HITS_CTES))
def q_token_list_hits(spark, sf):
    c = _c(spark, sf)
    ambiguous = c.accent_mapping().where(F.col("form_rank") > 1).select(F.col("anglicised").alias("word"))
    real = c.lexicon_split().where("in_lexicon").select(F.col("anglicised").alias("word"))
    f = c.features_core().select("pair_id", "fr", F.col("potential_fr_accent_issues").alias("uncommon_hits"))
    f = A.word_lists_hits(f, {"ambiguous_hits": ambiguous, "real_word_hits": real}, "fr")
    return f.select("pair_id", "ambiguous_hits", "real_word_hits", "uncommon_hits")


@register("token_list_hits_sieved", with_all(TOKEN_HITS_SQL, TOKEN_HITS_CTES))
def q_token_list_hits_sieved(spark, sf):
    """Op 27 as for lists too long to broadcast: a Bloom filter, then shuffle joins of its candidates."""
    c = _c(spark, sf)
    ambiguous = c.accent_mapping().where(F.col("form_rank") > 1).select(F.col("anglicised").alias("word"))
    real = c.lexicon_split().where("in_lexicon").select(F.col("anglicised").alias("word"))
    f = c.features_core().select("pair_id", "fr", F.col("potential_fr_accent_issues").alias("uncommon_hits"))
    f = A.word_lists_hits(f, {"ambiguous_hits": ambiguous, "real_word_hits": real}, "fr", broadcast_words=False)
    return f.select("pair_id", "ambiguous_hits", "real_word_hits", "uncommon_hits")


FIG_NAMES = ["has_trailing_numbers", "has_parenthetical_numbers", "has_figure_references",
             "has_repeated_punctuation", "exclude_figtext"]


def _figtext_long_sql() -> str:
    parts = []
    for lang in ("en", "fr"):
        f = O.figtext(lang, lang)
        cols = ", ".join(f"{f[n]} AS {n}" for n in FIG_NAMES)
        parts.append(f"SELECT pair_id, '{lang}' AS lang, {cols} FROM features")
    return "\nUNION ALL\n".join(parts)


@register("figtext_flags", with_all(_figtext_long_sql()))
def q_figtext_flags(spark, sf):
    f = _c(spark, sf).features()
    out = None
    for lang in ("en", "fr"):
        flags = T.figtext_flags(lang, lang)
        part = f.select("pair_id", F.lit(lang).alias("lang"), *[flags[n].alias(n) for n in FIG_NAMES])
        out = part if out is None else out.unionByName(part)
    return out


def _figtext_wide_sql() -> str:
    en, fr = O.figtext("en", "en"), O.figtext("fr", "fr")
    cols = [f"{en[n]} AS {n}_en" for n in FIG_NAMES] + [f"{fr[n]} AS {n}_fr" for n in FIG_NAMES]
    cols.append(f"({en['exclude_figtext']} OR {fr['exclude_figtext']}) AS exclude_figtext")
    return "SELECT pair_id, " + ", ".join(cols) + " FROM features"


@register("figtext_bilingual", with_all(_figtext_wide_sql()))
def q_figtext_bilingual(spark, sf):
    f = _c(spark, sf).features()
    en, fr = T.figtext_flags("en", "en"), T.figtext_flags("fr", "fr")
    cols = [en[n].alias(f"{n}_en") for n in FIG_NAMES] + [fr[n].alias(f"{n}_fr") for n in FIG_NAMES]
    cols.append((en["exclude_figtext"] | fr["exclude_figtext"]).alias("exclude_figtext"))
    return f.select("pair_id", *cols)


@register("figtext_simple", with_all("SELECT pair_id, exclude_figtext FROM gated"))
def q_figtext_simple(spark, sf):
    return _c(spark, sf).gate_flags().select("pair_id", "exclude_figtext")


@register("has_date_refs", with_all("SELECT pair_id, has_date_refs FROM gated"))
def q_has_date_refs(spark, sf):
    return _c(spark, sf).gate_flags().select("pair_id", "has_date_refs")


@register("append_period", with_all("SELECT pair_id, fr || '.' AS fr, en || '.' AS en FROM features"))
def q_append_period(spark, sf):
    f = _c(spark, sf).features()
    return f.select("pair_id", T.append_period("fr").alias("fr"), T.append_period("en").alias("en"))


@register("clean_common_patterns", with_all(
    f"SELECT pair_id, {sql_clean('fr')} AS fr_clean, {sql_clean('en')} AS en_clean FROM pairs"))
def q_clean_common_patterns(spark, sf):
    p = _c(spark, sf).pairs()
    return p.select("pair_id", T.clean_common_patterns("fr").alias("fr_clean"),
                    T.clean_common_patterns("en").alias("en_clean"))


def _prompt_sql(text: str, lang: str) -> str:
    en = K.PROMPT_TEMPLATE_EN.format(instruction=K.INSTRUCTION_EN, text="\x00")
    fr = K.PROMPT_TEMPLATE_FR.format(instruction=K.INSTRUCTION_FR, text="\x00")

    def fill(tpl):
        a, b = tpl.split("\x00")
        return f"({O.sql_str(a).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))} || {text} || " \
               f"{O.sql_str(b).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))})"
    return f"CASE WHEN starts_with(lower({lang}), 'en') THEN {fill(en)} ELSE {fill(fr)} END"


@register("build_prompt", with_all(f"SELECT record_id, {_prompt_sql('source', 'source_lang')} AS prompt FROM corpus"))
def q_build_prompt(spark, sf):
    return EV.corpus(_c(spark, sf)).select("record_id", T.build_prompt("source", "source_lang").alias("prompt"))


def _extract_sql() -> str:
    gen = (f"CASE WHEN record_id % 2 = 0 THEN prompt || ' ' || target || chr(10) || 'extra line' "
           f"ELSE 'Output: ' || target || chr(10) || 'noise' END")
    body = (f"CASE WHEN strpos(g, '[/INST]') > 0 THEN substr(g, strpos(g, '[/INST]') + 7) "
            f"ELSE replace(g, prompt, '') END")
    first = f"string_split({O.strip_ws(body)}, chr(10))[1]"
    return (f"SELECT record_id, {O.strip_ws(first)} AS response FROM ("
            f"SELECT record_id, prompt, {gen} AS g FROM ("
            f"SELECT record_id, target, {_prompt_sql('source', 'source_lang')} AS prompt FROM corpus))")


@register("extract_response", with_all(_extract_sql()))
def q_extract_response(spark, sf):
    r = EV.prompts_and_outputs(_c(spark, sf))
    return r.select("record_id", T.extract_response("generated", "prompt").alias("response"))


ROUTE_LANG_SQL = """
SELECT c.record_id, r.model, c.source_lang,
  CASE WHEN c.source_lang = 'fr' THEN 'en' ELSE 'fr' END AS target_lang,
  coalesce(r.language_map[c.source_lang], c.source_lang) AS src_code,
  coalesce(r.language_map[CASE WHEN c.source_lang = 'fr' THEN 'en' ELSE 'fr' END],
           CASE WHEN c.source_lang = 'fr' THEN 'en' ELSE 'fr' END) AS tgt_code
FROM corpus c CROSS JOIN registry r"""


@register("route_language", with_all(ROUTE_LANG_SQL))
def q_route_language(spark, sf):
    return P.route_language(EV.corpus(_c(spark, sf)))


ROUTE_MODEL_SQL = """
SELECT c.record_id, t.translator_name,
  coalesce(CASE WHEN c.source_lang = 'en' THEN t.merged_model_path_en_fr
                WHEN c.source_lang = 'fr' THEN t.merged_model_path_fr_en END,
           t.merged_model_path,
           CASE WHEN t.family = 'opus' THEN regexp_replace(t.base_model_id, '-(en-fr|fr-en)$', '') || '-'
                || c.source_lang || '-' || CASE WHEN c.source_lang = 'fr' THEN 'en' ELSE 'fr' END
                ELSE t.base_model_id END) AS model_path
FROM corpus c CROSS JOIN translators t"""


@register("route_model", with_all(ROUTE_MODEL_SQL))
def q_route_model(spark, sf):
    return E.route_model(EV.corpus(_c(spark, sf)))


def _tag_sql() -> str:
    tagged = ("CASE WHEN record_id % 97 = 5 THEN source || repeat(' <KE' || CAST(pair_id % 7 + 1 AS VARCHAR) || '>', 200) "
              "WHEN record_id % 3 = 0 THEN '<KE' || CAST(pair_id % 7 + 1 AS VARCHAR) || '>' || source || '</KE' "
              "|| CAST(pair_id % 7 + 1 AS VARCHAR) || '>' WHEN record_id % 3 = 1 THEN source || ' <KE' || "
              "CAST(pair_id % 7 + 1 AS VARCHAR) || '> <KE' || CAST(pair_id % 7 + 1 AS VARCHAR) || '>' ELSE source END")
    pool = ("flatten(list_transform(range(1, 1025), lambda i: ['<KE' || CAST(i AS VARCHAR) || '>', "
            "'</KE' || CAST(i AS VARCHAR) || '>']))")
    return (f"SELECT record_id, text, present_all[1:128] AS present_tags, "
            f"list_filter({pool}, lambda t: list_contains(present_all, t)) AS allowed_tags, "
            f"CAST(len(list_filter({pool}, lambda t: NOT list_contains(present_all, t))) AS INTEGER) AS n_banned FROM ("
            f"SELECT record_id, text, regexp_extract_all(coalesce(text, ''), '(</?KE[0-9]+>)', 1) AS present_all FROM ("
            f"SELECT record_id, {tagged} AS text FROM corpus))")


@register("tag_constraints", with_all(_tag_sql()))
def q_tag_constraints(spark, sf):
    return E.tag_constraints(EV.tagged_records(_c(spark, sf)), "text")


@register("quality_delta", with_all(
    "SELECT pair_id, translator_name, cosine_similarity_vs_target AS similarity_to_old_translation, "
    "round(cosine_similarity_vs_source - cosine_similarity_original_translation, 6) AS quality_vs_tb "
    "FROM comparison"))
def q_quality_delta(spark, sf):
    d = E.quality_delta(EV.scores(_c(spark, sf)))
    return d.select("pair_id", "translator_name", "similarity_to_old_translation", "quality_vs_tb")


@register("cosine_similarity", with_all(
    "SELECT pair_id, translator_name, cosine_similarity_original_translation, cosine_similarity_vs_source, "
    "cosine_similarity_vs_target FROM comparison"))
def q_cosine_similarity(spark, sf):
    return EV.scores(_c(spark, sf)).select(
        "pair_id", "translator_name", "cosine_similarity_original_translation", "cosine_similarity_vs_source",
        "cosine_similarity_vs_target")


@register("model_from_filename", with_all(
    f"SELECT split_part(model, '_', 1) AS model_name, {', '.join(SWEEP_COLS)} FROM sweep"))
def q_model_from_filename(spark, sf):
    root = scratch_path(spark, "sweeps")
    trials = EV.sweep(_c(spark, sf))
    models = [m["model"] for m in K.MODEL_REGISTRY]
    for m in models:  # one results file per model, named <model>_sweep.csv
        trials.where(F.col("model") == m).select(*SWEEP_COLS) \
              .write.options(**IO.CSV_WRITE).csv(f"{root}/{m}_sweep.csv")
    read = spark.read.schema(IO.SWEEP_SCHEMA).options(**IO.CSV_READ).csv([f"{root}/{m}_sweep.csv" for m in models])
    return IO.model_from_filename(read).select("model_name", *SWEEP_COLS)


# ===================================== 2C filters, predicates, gates =====================================

@register("low_similarity", with_all("SELECT pair_id, exclude_low_similarity FROM gated"))
def q_low_similarity(spark, sf):
    return _c(spark, sf).gate_flags().select("pair_id", "exclude_low_similarity")


@register("tiered_bounds", with_all(
    "SELECT pair_id, " + ", ".join(f"exclude_{f}" for f in K.FEATURES) + " FROM gated"))
def q_tiered_bounds(spark, sf):
    return _c(spark, sf).gate_flags().select("pair_id", *[f"exclude_{f}" for f in K.FEATURES])


@register("exclude_any", with_all("SELECT pair_id, exclude FROM gated"))
def q_exclude_any(spark, sf):
    return _c(spark, sf).gate_flags().select("pair_id", "exclude")


@register("training_gate", with_all(TRAINING_SQL))
def q_training_gate(spark, sf):
    return P.bidirectional(G.training_pairs(_c(spark, sf).gated())) \
            .select("pair_id", "direction", "source", "target", "source_lang")


@register("relaxed_bounds", with_all(
    "SELECT pair_id, " + ", ".join(f"exclude_relaxed_{f}" for f in K.RELAXED_FEATURES) + ", exclude_relaxed FROM gated"))
def q_relaxed_bounds(spark, sf):
    return _c(spark, sf).gate_flags().select("pair_id", *[f"exclude_relaxed_{f}" for f in K.RELAXED_FEATURES],
                                        "exclude_relaxed")


RELAXED_SQL = """
SELECT pair_id, 0 AS direction, en AS source, fr AS target, 'en' AS source_lang FROM gated
WHERE NOT exclude_relaxed AND exclude AND fr IS NOT NULL AND en IS NOT NULL
UNION ALL
SELECT pair_id, 1 AS direction, fr AS source, en AS target, 'fr' AS source_lang FROM gated
WHERE NOT exclude_relaxed AND exclude AND fr IS NOT NULL AND en IS NOT NULL"""


@register("relaxed_test_set", with_all(RELAXED_SQL))
def q_relaxed_test_set(spark, sf):
    return P.bidirectional(G.relaxed_test_pairs(_c(spark, sf).gated())) \
            .select("pair_id", "direction", "source", "target", "source_lang")


@register("similarity_range", with_all("SELECT pair_id, fr, en, similarity FROM pairs "
                                       "WHERE similarity BETWEEN 0.75 AND 0.85"))
def q_similarity_range(spark, sf):
    return G.similarity_range(_c(spark, sf).pairs(), 0.75, 0.85)


LOOKUP_IDS = [0, 7, 42, 1000]


@register("point_lookup", with_all(
    "SELECT pair_id, fr, en, similarity FROM pairs WHERE pair_id IN (0, 7, 42, 1000) "
    "OR fr = (SELECT fr FROM pairs WHERE pair_id = 3)"))
def q_point_lookup(spark, sf):
    """By id, or by the text of pair 3 (a scalar: the stage's pair_id is unique)."""
    p = _c(spark, sf).pairs()
    needle = p.where(F.col("pair_id") == 3).select("fr").first()
    by_text = F.col("fr") == F.lit(needle["fr"]) if needle else F.lit(False)
    return p.where(F.col("pair_id").isin(LOOKUP_IDS) | by_text)


def _clustered(spark, sf) -> str:
    """A copy of the pairs in ranges of similarity, with a Bloom filter on the French text's digest."""
    c = _c(spark, sf)
    if "path" not in c.clustered:
        pairs = c.pairs()
        c.clustered["path"] = IO.write_clustered(pairs, scratch_path(spark, "clustered"), "similarity", bucket_count(pairs, 64), "fr")
    return c.clustered["path"]


@register("clustered_range", ORACLE["similarity_range"])
def q_clustered_range(spark, sf):
    """Op 48 on the clustered copy: only files whose range meets the band are opened."""
    return IO.read_range(spark, _clustered(spark, sf), "similarity", 0.75, 0.85).select("pair_id", "fr", "en", "similarity")


@register("clustered_text", with_all(
    "SELECT pair_id, fr, en, similarity FROM pairs WHERE fr = (SELECT fr FROM pairs WHERE pair_id = 3)"))
def q_clustered_text(spark, sf):
    """Op 49 on the clustered copy: the rows with the text of pair 3, through the digest's Bloom filter."""
    path = _clustered(spark, sf)
    needle = _c(spark, sf).pairs().where(F.col("pair_id") == 3).select("fr").first()
    if needle is None or needle["fr"] is None:
        return _c(spark, sf).pairs().limit(0).select("pair_id", "fr", "en", "similarity")
    return IO.read_text(spark, path, "fr", needle["fr"]).select("pair_id", "fr", "en", "similarity")


@register("restrict_language", with_all(
    "SELECT model, record_id, source_lang FROM restricted"))
def q_restrict_language(spark, sf):
    return G.restrict_language(EV.split_corpus(_c(spark, sf))) \
            .select("model", "record_id", "source_lang")


@register("drop_invalid_examples", with_all("SELECT model, record_id FROM valid"))
def q_drop_invalid(spark, sf):
    kept = G.restrict_language(G.drop_invalid_examples(EV.split_corpus(_c(spark, sf))))
    return kept.select("model", "record_id")


@register("require_rows", with_all(
    "SELECT model, CAST(count(*) AS BIGINT) AS n_rows FROM valid GROUP BY model"))
def q_require_rows(spark, sf):
    sizes = P.train_sizes(EV.split_corpus(_c(spark, sf)), P.registry(spark))
    return G.require_rows_per_model(sizes, "filtering").select("model", (F.col("train_rows") + F.col("eval_rows")).alias("n_rows"))


# ============================================== 2D joins ==============================================

CHANGED_SQL = """
SELECT * FROM (
  SELECT pair_id, 'apostrophe' AS stage, fr_raw AS fr_before, fr_apos AS fr_after FROM features
  UNION ALL SELECT pair_id, 'accent', fr_apos, fr FROM features
  UNION ALL SELECT pair_id, 'combined', fr_raw, fr FROM features)
WHERE fr_before IS DISTINCT FROM fr_after"""


@register("changed_rows", with_all(CHANGED_SQL))
def q_changed_rows(spark, sf):
    return E.changed_rows(_c(spark, sf).features())


IMPROVED_SQL = f"""
SELECT p.pair_id, p.similarity, a.similarity_updated, a.fr_updated, a.en_updated,
       (p.fr IS DISTINCT FROM a.fr_updated OR p.en IS DISTINCT FROM a.en_updated) AS changed
FROM pairs p JOIN (
  SELECT pair_id, {sql_clean('fr')} AS fr_updated, {sql_clean('en')} AS en_updated,
         CASE WHEN pair_id % 3 = 0 THEN similarity + 0.01 ELSE similarity END AS similarity_updated
  FROM pairs) a ON p.pair_id = a.pair_id
WHERE a.similarity_updated > p.similarity"""


def cleaned_copy(pairs: DataFrame) -> DataFrame:
    """Second version of the pairs: the clean-up chain on both sides, +0.01 similarity on every third."""
    return pairs.select("pair_id", T.clean_common_patterns("fr").alias("fr"), T.clean_common_patterns("en").alias("en"),
                        F.when(F.col("pair_id") % 3 == 0, F.col("similarity") + F.lit(0.01))
                         .otherwise(F.col("similarity")).alias("similarity"))


@register("improved_rows", with_all(IMPROVED_SQL))
def q_improved_rows(spark, sf):
    p = _c(spark, sf).pairs()
    return E.improved_rows(p, cleaned_copy(p))


@register("lexicon_split", with_all("SELECT anglicised, accented, count, in_lexicon FROM lex_split"))
def q_lexicon_split(spark, sf):
    return _c(spark, sf).lexicon_split()


GRID_SQL = """
SELECT g.model, g.lr, g.lora_r, g.lora_alpha, g.lora_dropout, least(s.train_rows, 200000) AS train_samples,
       least(s.eval_rows, 10000) AS eval_samples
FROM grid g JOIN sizes s ON g.model = s.model"""


@register("model_grid", with_all(GRID_SQL))
def q_model_grid(spark, sf):
    reg = P.registry(spark)
    sizes = P.train_sizes(EV.split_corpus(_c(spark, sf)), reg)
    return E.model_grid(reg).join(F.broadcast(sizes), "model").select(
        "model", "lr", "lora_r", "lora_alpha", "lora_dropout", *P.capped_samples())


@register("samples_x_translators", with_all("SELECT pair_id, " + ", ".join(COMPARISON_COLS) + " FROM comparison"))
def q_samples_x_translators(spark, sf):
    return EV.comparison(_c(spark, sf))


def _best_variant_sql() -> str:
    idx = "CAST(('0x' || substr(md5({t}), 1, 8)) AS BIGINT)"
    return f"""
SELECT pair_id,
  CASE WHEN better THEN f ELSE fr END AS fr, CASE WHEN better THEN e ELSE en END AS en,
  CASE WHEN better THEN round(cos, 6) ELSE similarity END AS similarity,
  vidx AS best_variant, round(cos, 6) AS best_cosine, better AS updated
FROM (
  SELECT *, coalesce(similarity < cos AND (f <> fr OR e <> en), false) AS better FROM (
    SELECT v.*, {raw_cosine('fv.vec', 'ev.vec')} AS cos,
           row_number() OVER (PARTITION BY v.pair_id ORDER BY {raw_cosine('fv.vec', 'ev.vec')} DESC, v.vidx) AS rn
    FROM (
      SELECT pair_id, similarity, fr, en, 0 AS vidx, fr AS f, en AS e FROM cl
      UNION ALL SELECT pair_id, similarity, fr, en, 1, fr, en_c FROM cl
      UNION ALL SELECT pair_id, similarity, fr, en, 2, fr_c, en FROM cl
      UNION ALL SELECT pair_id, similarity, fr, en, 3, fr_c, en_c FROM cl) v
    CROSS JOIN nvec
    JOIN emb fv ON fv.vec_id = {idx.format(t='v.f')} % nvec.n_vec
    JOIN emb ev ON ev.vec_id = {idx.format(t='v.e')} % nvec.n_vec)
  WHERE rn = 1)
UNION ALL
SELECT pair_id, fr, en, similarity, NULL, NULL, false FROM pairs WHERE fr IS NULL OR en IS NULL"""


BEST_VARIANT_CTE = f"""
cl AS (SELECT pair_id, similarity, fr, en, {sql_clean('fr')} AS fr_c, {sql_clean('en')} AS en_c FROM pairs)"""


def embedding_lookup(c) -> Callable[[DataFrame], DataFrame]:
    """Encoder stand-in for the registered query: text -> a row of the driver's ``embeddings``
    picked by md5(text); a caller passes ``plugins.embed_texts`` with a real model instead."""
    def encode(texts: DataFrame) -> DataFrame:
        emb = EV.embeddings(c)
        n_vec = emb.count()
        keyed = texts.distinct().withColumn(
            "vec_id", F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long") % F.lit(n_vec))
        # vectors stay float32 (as stored) through the joins; the dot products widen each element
        return keyed.join(emb.select("vec_id", F.col("embedding").alias("vec")), "vec_id").select("text", "vec")
    return encode


@register("best_variant", with_all(_best_variant_sql(), BEST_VARIANT_CTE))
def q_best_variant(spark, sf):
    c = _c(spark, sf)
    return E.best_variant(c.pairs(), embedding_lookup(c))


# =========================================== 2E aggregations ===========================================

def _match_counts_sql() -> str:
    miss = "coalesce(regexp_matches({c}, '(?i)(^| )[LDNMST] '), false)"
    return f"""
SELECT n_total, n_missing_apostrophe, n_missing_apostrophe_after, n_straight_apostrophe, n_curved_apostrophe,
  n_figtext, n_date_refs,
  round(n_missing_apostrophe / n_total, 6) AS pct_missing_apostrophe,
  round(n_missing_apostrophe_after / n_total, 6) AS pct_missing_apostrophe_after
FROM (SELECT CAST(count(*) AS BIGINT) AS n_total,
  CAST(count_if({miss.format(c='fr_raw')}) AS BIGINT) AS n_missing_apostrophe,
  CAST(count_if({miss.format(c='fr_apos')}) AS BIGINT) AS n_missing_apostrophe_after,
  CAST(sum(len(regexp_extract_all(fr_raw, ''''))) AS BIGINT) AS n_straight_apostrophe,
  CAST(sum(len(regexp_extract_all(fr_raw, '’'))) AS BIGINT) AS n_curved_apostrophe,
  CAST(count_if(exclude_figtext) AS BIGINT) AS n_figtext,
  CAST(count_if(has_date_refs) AS BIGINT) AS n_date_refs
FROM gated)"""


@register("match_counts", with_all(_match_counts_sql()))
def q_match_counts(spark, sf):
    return PR.match_counts(_c(spark, sf).gated())


@register("before_after_totals", with_all(f"""
SELECT before, after, before - after AS difference FROM (
  SELECT CAST(sum({O.one_char_words('fr_raw', K.ONE_CHAR_ALLOW_FR)}) AS BIGINT) AS before,
         CAST(sum({O.one_char_words('fr_apos', K.ONE_CHAR_ALLOW_FR)}) AS BIGINT) AS after FROM feats)"""))
def q_before_after(spark, sf):
    return PR.before_after_totals(_c(spark, sf).features_pre().join(_c(spark, sf).raw_texts(), "pair_id"))


def _long_sql(cols) -> str:
    return "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM features" for c in cols)


def _pct_cols(probs, names) -> str:
    # ties at the sixth digit are settled on ten decimal digits, as in the engine
    return ", ".join(f"CAST(round(CAST(round(quantile_cont(value, {p}), 10) AS DECIMAL(38, 10)), 6) AS DOUBLE) AS {n}" for p, n in zip(probs, names))


@register("describe_percentiles", with_all(
    f"SELECT feature, {_pct_cols(K.SIGMA_PERCENTILES, K.SIGMA_PERCENTILE_NAMES)} FROM ({_long_sql(PR.NUMERIC_FEATURES)}) "
    f"WHERE value IS NOT NULL GROUP BY feature"))
def q_describe_percentiles(spark, sf):
    return PR.describe_percentiles(_c(spark, sf).features_core())


def _describe_sql(cols, probs, names) -> str:
    return (f"SELECT feature, CAST(count(value) AS BIGINT) AS count, round(avg(value), 6) AS mean, "
            f"round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max, "
            f"{_pct_cols(probs, names)} FROM ({_long_sql(cols)}) GROUP BY feature")


@register("describe_column", with_all(_describe_sql(["potential_fr_accent_issues"], K.DESCRIBE_COLUMN_PERCENTILES,
                                                    K.DESCRIBE_COLUMN_PERCENTILE_NAMES)))
def q_describe_column(spark, sf):
    return PR.describe_column(_c(spark, sf).features_core())


@register("describe_all", with_all(_describe_sql(PR.NUMERIC_FEATURES, K.DESCRIBE_DEFAULT_PERCENTILES,
                                                 K.DESCRIBE_DEFAULT_PERCENTILE_NAMES)))
def q_describe_all(spark, sf):
    return PR.describe_all(_c(spark, sf).features_core())


HIST_SQL = """
SELECT CAST(b.bin AS INTEGER) AS bin, round(b.lower, 6) AS lower, round(b.upper, 6) AS upper,
       (SELECT count(*) FROM pairs WHERE similarity >= b.lower AND (similarity < b.upper OR (b.bin = 29 AND similarity <= b.upper))) AS count
FROM (
  SELECT bin, bin * ((mx - mn) / 30) + mn AS lower, CASE WHEN bin = 29 THEN mx ELSE (bin + 1) * ((mx - mn) / 30) + mn END AS upper
  FROM (SELECT CASE WHEN min(similarity) = max(similarity) THEN min(similarity) - 0.5 ELSE min(similarity) END AS mn,
               CASE WHEN min(similarity) = max(similarity) THEN max(similarity) + 0.5 ELSE max(similarity) END AS mx FROM pairs),
       range(30) AS r(bin)) b"""


@register("similarity_histogram", with_all(HIST_SQL))
def q_similarity_histogram(spark, sf):
    return PR.similarity_histogram(_c(spark, sf).pairs())


def _outlier_sql() -> str:
    parts = []
    for tier, bounds in K.OUTLIER_CRITERIA.items():
        for f in K.FEATURES:
            lo, hi = bounds[f]
            parts.append(f"SELECT '{tier}' AS tier, '{f}' AS feature, CAST(count_if({f} < {lo}) AS BIGINT) AS n_below, "
                         f"CAST(count_if({f} > {hi}) AS BIGINT) AS n_above FROM features")
    return "\nUNION ALL\n".join(parts)


@register("outlier_counts", with_all(_outlier_sql()))
def q_outlier_counts(spark, sf):
    return PR.outlier_counts(_c(spark, sf).features_core())


def _exclusion_sql() -> str:
    cols = []
    for c in K.EXCLUSION_COLUMNS + ["exclude"]:
        v = c if c == "potential_fr_accent_issues" else f"CAST({c} AS BIGINT)"
        cols.append(f"CAST(coalesce(sum({v}), 0) AS BIGINT) AS {c}")
    return "SELECT " + ", ".join(cols) + " FROM gated"


@register("exclusion_summary", with_all(_exclusion_sql()))
def q_exclusion_summary(spark, sf):
    return PR.exclusion_summary(_c(spark, sf).gate_flags())


@register("observed_gate", with_all(_exclusion_sql().replace("SELECT ", "SELECT CAST(count(*) AS BIGINT) AS n_total, "
    "CAST(count_if(NOT exclude) AS BIGINT) AS n_kept, CAST(count_if(similarity > 0.8) AS BIGINT) AS n_above_threshold, ", 1)))
def q_observed_gate(spark, sf):
    """Ops 66 and 67 as metrics observed by the job that wrote the gate's flags."""
    seen = _c(spark, sf).gate_metrics()
    return spark.createDataFrame([tuple(int(v or 0) for v in seen.values())], ", ".join(f"{n} long" for n in seen))


@register("kept_fraction", with_all("""
SELECT n_total, n_kept, n_above_threshold, round(n_kept / n_total, 6) AS kept_share,
       round(n_above_threshold / n_total, 6) AS above_threshold_share
FROM (SELECT CAST(count(*) AS BIGINT) AS n_total, CAST(count_if(NOT exclude) AS BIGINT) AS n_kept,
             CAST(count_if(similarity > 0.8) AS BIGINT) AS n_above_threshold FROM gated)"""))
def q_kept_fraction(spark, sf):
    return PR.kept_fraction(_c(spark, sf).gate_flags())


@register("accent_mapping", with_all(
    "SELECT accented, count, anglicised, n_forms, CAST(form_rank AS INTEGER) AS form_rank FROM acc_map"))
def q_accent_mapping(spark, sf):
    m = _c(spark, sf).accent_mapping()
    return m.select("accented", "count", "anglicised", "n_forms", "form_rank")


def _translator_stats_sql() -> str:
    pct = _pct_cols(K.TRANSLATOR_PERCENTILES, K.TRANSLATOR_PERCENTILE_NAMES)
    long_sql = ("SELECT translator_name, 'quality_vs_tb' AS metric, "
                "round(cosine_similarity_vs_source - cosine_similarity_original_translation, 6) AS value "
                "FROM comparison UNION ALL SELECT translator_name, 'similarity_to_old_translation', "
                "cosine_similarity_vs_target FROM comparison")
    return (f"SELECT translator_name, metric, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, "
            f"{pct} FROM ({long_sql}) WHERE translator_name IS NOT NULL GROUP BY translator_name, metric")


@register("translator_stats", with_all(_translator_stats_sql()))
def q_translator_stats(spark, sf):
    return E.translator_stats(E.quality_delta(EV.scores(_c(spark, sf))))


def _categorical_sql() -> str:
    cats = sorted(c for c in EV.SURVEY_CATEGORIES if c)
    long_sql = " UNION ALL ".join(f"SELECT '{n}' AS column_name, {n} AS category FROM survey" for n in EV.COMPARED)
    cols = ", ".join(f"CAST(count_if(category = '{c}') AS BIGINT) AS {c}" for c in cats)
    return (f"SELECT column_name, {cols}, CAST(count_if(category IS NULL) AS BIGINT) AS NaN "
            f"FROM ({long_sql}) GROUP BY column_name")


@register("categorical_counts", with_all(_categorical_sql()))
def q_categorical_counts(spark, sf):
    return E.categorical_counts(EV.survey(_c(spark, sf)), [x for x in EV.SURVEY_CATEGORIES if x])


def _weighted_sql() -> str:
    long_sql = " UNION ALL ".join(f"SELECT '{n}' AS column_name, {n} AS category FROM survey" for n in EV.COMPARED)
    case = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.SURVEY_WEIGHTS.items()) + " END"
    return f"SELECT column_name, CAST(coalesce(sum({case}), 0) AS BIGINT) AS score FROM ({long_sql}) GROUP BY column_name"


@register("weighted_score", with_all(_weighted_sql()))
def q_weighted_score(spark, sf):
    return E.weighted_score(EV.survey(_c(spark, sf)))


@register("train_sizes", with_all("SELECT model, train_rows, eval_rows, steps_per_epoch FROM sizes"))
def q_train_sizes(spark, sf):
    return P.train_sizes(EV.split_corpus(_c(spark, sf)), P.registry(spark)).drop("train_chars", "eval_chars")


# ====================================== 2F model-input preparation ======================================

def _vocab_cte() -> str:
    toks = f"list_concat({O.tokens(O.strip_ws('source'))}, {O.tokens(O.strip_ws('target'))})"
    return f"""
tok_counts AS (SELECT token, count(*) AS cnt FROM (SELECT unnest({toks}) AS token FROM corpus) GROUP BY token),
vocab_ids AS (SELECT token, row_number() OVER (ORDER BY cnt DESC, token) - 1 + 5 AS token_id FROM tok_counts),
valid_recs AS (SELECT * FROM corpus WHERE length({O.strip_ws('target')}) > 0),
src_ids AS (
  SELECT record_id, list(CAST(token_id AS INTEGER) ORDER BY pos) AS ids FROM (
    SELECT record_id, unnest(l) AS token, unnest(range(len(l))) AS pos FROM (
      SELECT record_id, {O.tokens(O.strip_ws('source'))} AS l FROM valid_recs)) x
  JOIN vocab_ids USING (token) GROUP BY record_id),
tgt_ids AS (
  SELECT record_id, list(CAST(token_id AS INTEGER) ORDER BY pos) AS ids FROM (
    SELECT record_id, unnest(l) AS token, unnest(range(len(l))) AS pos FROM (
      SELECT record_id, {O.tokens(O.strip_ws('target'))} AS l FROM valid_recs)) x
  JOIN vocab_ids USING (token) GROUP BY record_id),
tokenized0 AS (
  SELECT v.record_id, v.source_lang,
    list_concat(coalesce(s.ids, []::INTEGER[])[1:{K.MAX_SOURCE_LEN - 1}], [1]) AS input_ids,
    list_concat(t.ids[1:{K.MAX_TARGET_LEN - 1}], [1]) AS labels
  FROM valid_recs v JOIN tgt_ids t ON v.record_id = t.record_id LEFT JOIN src_ids s ON v.record_id = s.record_id),
tokenized AS (
  SELECT record_id, input_ids, labels,
    list_concat([CASE WHEN source_lang = 'fr' THEN 3 ELSE 4 END], labels[1:len(labels) - 1]) AS decoder_input_ids
  FROM tokenized0)"""


@register("tokenize_pairs", with_all("SELECT record_id, input_ids, labels, decoder_input_ids FROM tokenized",
                                        _vocab_cte()))
def q_tokenize_pairs(spark, sf):
    return EV.tokens(_c(spark, sf))


SUBWORD_SIZE = 4000


@register("subword_vocabulary")
def q_subword_vocabulary(spark, sf):
    """Op 73, learned: the pieces with their ids and log-probabilities."""
    model = EV.subwords(_c(spark, sf), SUBWORD_SIZE)
    return spark.createDataFrame([(p, i, round(model.scores[p], 6)) for p, i in model.ids().items()], "piece string, piece_id int, score double")


@register("subword_tokens")
def q_subword_tokens(spark, sf):
    """Op 73 with the learned vocabulary, over both directions of all pairs."""
    c = _c(spark, sf)
    return SW.tokenize_subwords(EV.corpus(c), EV.subwords(c, SUBWORD_SIZE))


def _shuffle_cte() -> str:
    key = "md5('shuffle:42:' || CAST(record_id AS VARCHAR))"
    return f"""
shuffled AS (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY {key}, record_id) - 1 AS position FROM split_corpus)"""


SHIFT_SQL = """
SELECT record_id, split, batch_id,
  list_concat(input_ids, list_transform(range(in_len - len(input_ids)), lambda x: 0)) AS input_ids,
  list_concat(list_transform(range(len(input_ids)), lambda x: 1), list_transform(range(in_len - len(input_ids)), lambda x: 0))
    AS attention_mask,
  list_concat(labels, list_transform(range(lab_len - len(labels)), lambda x: -100)) AS labels,
  list_concat(list_transform(list_concat(labels, list_transform(range(lab_len - len(labels)), lambda x: -100))[1:1],
                             lambda t: CASE WHEN t = -100 THEN 0 ELSE t END),
              list_transform(list_concat(labels, list_transform(range(lab_len - len(labels)), lambda x: -100))[1:lab_len - 1],
                             lambda t: CASE WHEN t = -100 THEN 0 ELSE t END)) AS decoder_input_ids
FROM (
  SELECT t.record_id, s.split, CAST(floor(s.position / 8) AS BIGINT) AS batch_id, t.input_ids, t.labels,
    max(len(t.input_ids)) OVER (PARTITION BY s.split, CAST(floor(s.position / 8) AS BIGINT)) AS in_len,
    max(len(t.labels)) OVER (PARTITION BY s.split, CAST(floor(s.position / 8) AS BIGINT)) AS lab_len
  FROM tokenized t JOIN shuffled s ON t.record_id = s.record_id)"""


@register("shift_and_pad", with_all(SHIFT_SQL, _vocab_cte() + "," + _shuffle_cte()))
def q_shift_and_pad(spark, sf):
    c = _c(spark, sf)
    toks = EV.written_tokens(c)
    pos = EV.shuffled_split(c).select(F.shiftright("record_id", 1).alias("pair_id"), "record_id", "split", "position")
    return P.shift_and_pad(toks, pos, batch_size=8, partition_key="pair_id")


EMBED_SQL = """
SELECT text, list_transform(n, lambda x: round(x / sqrt(list_sum(list_transform(n, lambda y: y * y))), 6)) AS vec FROM (
  SELECT text, list_transform(range(64), lambda s: CAST(len(list_filter(slots, lambda x: x = s)) AS DOUBLE)) AS n FROM (
    SELECT text, list_transform(range(1, length(text) + 3), lambda i: CAST('0x' || substr(md5(substr('  ' || text || '  ', i, 3)), 1, 8) AS BIGINT) % 64) AS slots
    FROM (SELECT DISTINCT coalesce(source, '') AS text FROM corpus)))"""


@register("embed_translate_batches", with_all(EMBED_SQL))
def q_embed_translate_batches(spark, sf):
    """The default encoder; a caller's model goes through ``plugins.embed_texts``."""
    texts = EV.corpus(_c(spark, sf)).select(F.coalesce("source", F.lit("")).alias("text"))
    return trigram_embeddings(texts).select("text", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


# ================================ 2G sorts, top-k, limits, sampling, splits ================================

@register("top_words", with_all("SELECT anglicised, accented, count, vocab_rank, in_map FROM vocab2"))
def q_top_words(spark, sf):
    return _c(spark, sf).vocabulary().select("anglicised", "accented", "count", "vocab_rank", "in_map")


BEST_TRIAL_SQL = """
SELECT model, lr, lora_r, lora_alpha, lora_dropout, final_eval_loss FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY final_eval_loss ASC NULLS LAST, trial_dir) AS rn FROM sweep)
WHERE rn = 1"""


@register("best_trial", with_all(BEST_TRIAL_SQL))
def q_best_trial(spark, sf):
    return E.best_trial(EV.sweep(_c(spark, sf)))


@register("compare_models")
def q_compare_models(spark, sf):
    """Ops 57 and 75 through the plug-ins: every pair with two stand-in translators and the hashing encoder."""
    samples = _c(spark, sf).pairs().select(F.col("en").alias("source"), F.col("fr").alias("target"), F.lit("en").alias("source_lang"))
    return E.compare_translations(samples, {"reversed": PL.reversing_translator, "marked": PL.marking_translator},
                                  PL.default_encoder_factory(), 64)


def _sample_key(id_sql: str) -> str:
    return f"md5('sample:42:' || CAST({id_sql} AS VARCHAR))"


@register("sample_rows", with_all(
    f"SELECT * FROM corpus WHERE source_lang = 'fr' ORDER BY {_sample_key('record_id')}, record_id LIMIT 100"))
def q_sample_rows(spark, sf):
    return S.sample_rows(EV.corpus(_c(spark, sf)), 100, "record_id", lang="fr")


@register("sample_band", with_all(
    f"SELECT * FROM (SELECT pair_id, fr, en, similarity FROM pairs WHERE similarity BETWEEN 0.7 AND 0.8 "
    f"ORDER BY {_sample_key('pair_id')}, pair_id LIMIT 42) ORDER BY similarity, pair_id"))
def q_sample_band(spark, sf):
    return S.sample_band(_c(spark, sf).pairs().select("pair_id", "fr", "en", "similarity"), 42, 0.7, 0.8)


def _band_sample_sql(start: int, n: int) -> str:
    return f"""
  SELECT p.pair_id, p.fr, p.en, p.similarity, b.band_lo, b.band_hi,
         row_number() OVER (PARTITION BY b.band_lo, b.band_hi ORDER BY {_sample_key('p.pair_id')}, p.pair_id) AS rn
  FROM pairs p JOIN (SELECT x / 100.0 AS band_lo, (x + 5) / 100.0 AS band_hi FROM range({start}, 100, 5) t(x)) b
    ON p.similarity BETWEEN b.band_lo AND b.band_hi"""


SAMPLE_PER_BAND_SQL = f"""
SELECT pair_id, fr, en, similarity, band_lo, band_hi, 'all_10' AS variant FROM ({_band_sample_sql(70, 10)})
WHERE rn <= 10
UNION ALL
SELECT s.pair_id, s.fr, s.en, s.similarity, s.band_lo, s.band_hi, 'improved_100' AS variant
FROM ({_band_sample_sql(80, 100)}) s
WHERE s.rn <= 100 AND s.pair_id IN (SELECT pair_id FROM ({IMPROVED_SQL}))"""


@register("sample_per_band", with_all(SAMPLE_PER_BAND_SQL))
def q_sample_per_band(spark, sf):
    """Both uses of op 80: 10 rows per band over 0.70-1.00, and 100 rows per band over 0.80-1.00 of
    which only those whose cleaned version scores higher are reported."""
    p = _c(spark, sf).pairs().select("pair_id", "fr", "en", "similarity")
    every = S.sample_per_band(p, 10).withColumn("variant", F.lit("all_10"))
    improved = E.improved_rows(p, cleaned_copy(p)).select("pair_id")
    wide = S.sample_per_band(p, 100, start=80).join(improved, "pair_id", "left_semi")
    return every.unionByName(wide.withColumn("variant", F.lit("improved_100")))


@register("train_eval_split", with_all("""
SELECT record_id, source_lang, split,
  CASE WHEN row_number() OVER (ORDER BY md5('42:' || CAST(record_id AS VARCHAR)), record_id) - 1
            < ceil((SELECT count(*) FROM split_corpus) * 0.05) THEN 'eval' ELSE 'train' END AS split_exact
FROM split_corpus"""))
def q_train_eval_split(spark, sf):
    """Both variants of op 81: hash threshold (``split``) and exact size (``split_exact``)."""
    recs = EV.split_corpus(_c(spark, sf)).select("record_id", "source_lang", "split")
    return S.train_eval_split_exact(recs, "record_id", out_col="split_exact")


@register("seeded_shuffle", with_all("SELECT record_id, split, position FROM shuffled", _shuffle_cte()))
def q_seeded_shuffle(spark, sf):
    return EV.shuffled_split(_c(spark, sf)).select("record_id", "split", "position")


# caps that cut at every scale factor; the sweep's own (200,000 / 10,000) are the default of the operator
CAPS = {"train": 500, "eval": 50}


@register("cap_rows", with_all(f"""
SELECT model, record_id, split, position FROM (
  SELECT model, record_id, split,
         row_number() OVER (PARTITION BY model, split ORDER BY md5('shuffle:42:' || CAST(record_id AS VARCHAR)), record_id) - 1 AS position
  FROM restricted)
WHERE (split = 'train' AND position < {CAPS['train']}) OR (split = 'eval' AND position < {CAPS['eval']})"""))
def q_cap_rows(spark, sf):
    """The order of the original: language filter, split, shuffle, cap; each model on its own."""
    records = EV.split_corpus(_c(spark, sf)).select("record_id", "source_lang", "split")
    return S.cap_rows_per_model(records, "record_id", CAPS)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_training_gate(spark, sf_dir)
