"""Filters, predicates and gates (ops 42-52).

All gates are row-local column expressions, so they run unchanged on a streaming DataFrame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T


def low_similarity(similarity="similarity", threshold: float = K.LOW_SIMILARITY) -> Column:
    """Op 42. A missing similarity is not excluded (NaN < x is False in pandas)."""
    return F.coalesce(F.col(similarity) < F.lit(threshold), F.lit(False))


def tier(similarity="similarity") -> Column:
    s = F.col(similarity)
    return (F.when(s < K.TIER_S1_BELOW, F.lit("s1"))
             .when((s >= K.TIER_S1_BELOW) & (s < K.TIER_S2_BELOW), F.lit("s2"))
             .when(s >= K.TIER_S2_BELOW, F.lit("s3")))


def outside(value: Column, low: float, high: float) -> Column:
    """pandas ``~between``: a missing value counts as outside."""
    return ~F.coalesce(value.between(F.lit(low), F.lit(high)), F.lit(False))


def tiered_bounds(features=K.FEATURES, criteria=K.OUTLIER_CRITERIA, similarity="similarity") -> dict[str, Column]:
    """Op 43: ``exclude_<feature>`` per feature, the bounds chosen by the similarity tier."""
    t = tier(similarity)
    out = {}
    for feat in features:
        expr = F.lit(False)
        for name in ("s3", "s2", "s1"):
            lo, hi = criteria[name][feat]
            expr = F.when(t == name, outside(F.col(feat), lo, hi)).otherwise(expr)
        out[f"exclude_{feat}"] = expr
    return out


def exclude_any(columns=K.EXCLUSION_COLUMNS) -> Column:
    """Op 44: OR over flag columns; a count column counts as true when non-zero."""
    def truthy(c: str) -> Column:
        return F.coalesce(F.col(c) != 0, F.lit(False)) if c == "potential_fr_accent_issues" \
            else F.coalesce(F.col(c), F.lit(False))
    return reduce(lambda a, b: a | b, [truthy(c) for c in columns])


def relaxed_bounds(features=K.RELAXED_FEATURES, criteria=K.OUTLIER_CRITERIA) -> dict[str, Column]:
    """Op 46: tier-s3 bounds on every row."""
    return {f"exclude_relaxed_{f}": outside(F.col(f), *criteria["s3"][f]) for f in features}


def add_gate_columns(features: DataFrame) -> DataFrame:
    """Ops 42, 43, 30, 31, 44, 46 as one projection over the feature table."""
    en_flags = T.figtext_flags("en", "en")
    fr_flags = T.figtext_flags("fr", "fr")
    cols = {"exclude_low_similarity": low_similarity()}
    cols.update(tiered_bounds())
    cols["exclude_figtext"] = en_flags["exclude_figtext"] | fr_flags["exclude_figtext"]
    cols["has_date_refs"] = T.has_date_refs("en", "fr")
    staged = features.withColumns(cols)
    staged = staged.withColumn("exclude", exclude_any())
    relaxed = relaxed_bounds()
    staged = staged.withColumns(relaxed)
    return staged.withColumn("exclude_relaxed", reduce(lambda a, b: a | b, [F.col(c) for c in relaxed]))


def training_pairs(gated: DataFrame) -> DataFrame:
    """Op 45 (before the bidirectional expansion): kept pairs with a period appended to both sides."""
    return (gated.where(~F.col("exclude") & F.col("fr").isNotNull() & F.col("en").isNotNull())
                 .select("pair_id", T.append_period("fr").alias("fr"), T.append_period("en").alias("en")))


def relaxed_test_pairs(gated: DataFrame) -> DataFrame:
    """Op 47: excluded by the strict gate but inside the relaxed bounds; no period appended."""
    return (gated.where(~F.col("exclude_relaxed") & F.col("exclude")
                        & F.col("fr").isNotNull() & F.col("en").isNotNull())
                 .select("pair_id", "fr", "en"))


def similarity_range(df: DataFrame, lo: float, hi: float, col: str = "similarity") -> DataFrame:
    """Op 48: inclusive on both ends."""
    return df.where(F.col(col).between(F.lit(lo), F.lit(hi)))


def restrict_language(corpus: DataFrame, models=K.MODEL_REGISTRY) -> DataFrame:
    """Op 50: each model keeps the records whose source language equals its restriction (if any).

    Each record is fanned out to the configured models with a generate and filtered; no join.
    """
    from .prep import registry_entries
    fanned = corpus.select("*", F.explode(registry_entries(models)).alias("_m"))
    restrict = F.col("_m.restrict_source_language")
    return (fanned.where(restrict.isNull() | (F.col("source_lang") == restrict))
                  .select(*corpus.columns, F.col("_m.model").alias("model")))


def drop_invalid_examples(df: DataFrame) -> DataFrame:
    """Op 51: targets that are empty after strip go; so do rows left without labels."""
    keep = F.length(T.py_strip("target")) > 0
    if "labels" in df.columns:
        keep = keep & F.col("labels").isNotNull() & (F.size("labels") > 0)
    return df.where(keep)


class EmptyResultError(ValueError):
    pass


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Op 52: fail with a named error at a job boundary when nothing is left."""
    if df.isEmpty():
        raise EmptyResultError(f"No data remaining after {what}")
    return df


def write_required(df: DataFrame, what: str, metrics: dict[str, Column] | None = None) -> tuple[DataFrame, dict[str, object]]:
    """Op 52 at a stage's end: writes ``df`` and fails with the named error if it has no rows. The rows are counted by
    the job that writes them (with ``metrics``, any aggregates, beside them), so the guard runs no job of its own."""
    from ..session import materialize_observed
    written, seen = materialize_observed(df, "required", {"n_rows": F.count(F.lit(1)), **(metrics or {})})
    if not seen["n_rows"]:
        raise EmptyResultError(f"No data remaining after {what}")
    return written, seen


def require_rows_per_model(sizes: DataFrame, what: str) -> DataFrame:
    """Op 52 per model and split: ``sizes`` (model, train_rows, eval_rows; a row per configured model) if no model
    lacks rows of either split, else a named error that lists the models that do."""
    short = sizes.where((F.col("train_rows") == 0) | (F.col("eval_rows") == 0)).select("model", "train_rows", "eval_rows") \
                 .orderBy("model").collect()
    if short:
        raise EmptyResultError(f"No data remaining after {what} for " + ", ".join(
            f"{r['model']} ({' and '.join(s for s in ('train', 'eval') if not r[f'{s}_rows'])})" for r in short))
    return sizes


class UnknownModelError(ValueError):
    pass


def require_model(name: str, models=K.MODEL_REGISTRY) -> dict:
    """Op 52: the registry entry of a model, or a named error listing the known models."""
    for m in models:
        if m["model"] == name:
            return m
    raise UnknownModelError(f"Model '{name}' not found. Available models: {[m['model'] for m in models]}")
