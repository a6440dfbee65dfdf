"""Corpus profiling aggregates (ops 59-67). All are partial+final aggregates except the
percentiles, which use the distributed exact method in ``operators.quantiles``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from .quantiles import exact_percentiles

NUMERIC_FEATURES = ["similarity", "len_ratio", "verb_ratio", "noun_ratio", "entity_ratio", "clause_ratio",
                    "one_char_words_fr", "one_char_words_en", "potential_fr_accent_issues"]


def match_counts(gated: DataFrame) -> DataFrame:
    """Op 59: rows matching each check, the total and shares; apostrophe occurrence sums."""
    agg = gated.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(T.missing_apostrophe("fr_raw")).alias("n_missing_apostrophe"),
        F.count_if(T.missing_apostrophe("fr_apos")).alias("n_missing_apostrophe_after"),
        F.sum(T.char_occurrences("fr_raw", K.STRAIGHT_APOSTROPHE)).cast("long").alias("n_straight_apostrophe"),
        F.sum(T.char_occurrences("fr_raw", K.CURVED_APOSTROPHE)).cast("long").alias("n_curved_apostrophe"),
        F.count_if("exclude_figtext").alias("n_figtext"),
        F.count_if("has_date_refs").alias("n_date_refs"),
    )
    return agg.withColumns({
        "pct_missing_apostrophe": F.round(F.try_divide(F.col("n_missing_apostrophe"), F.col("n_total")), 6),
        "pct_missing_apostrophe_after": F.round(F.try_divide(F.col("n_missing_apostrophe_after"),
                                                             F.col("n_total")), 6),
    })


def before_after_totals(features: DataFrame) -> DataFrame:
    """Op 60: single-character French words before and after the apostrophe repair."""
    before = F.sum(T.one_char_words("fr_raw", K.ONE_CHAR_ALLOW_FR)).cast("long")
    after = F.sum(T.one_char_words("fr_apos", K.ONE_CHAR_ALLOW_FR)).cast("long")
    return (features.agg(before.alias("before"), after.alias("after"))
                    .withColumn("difference", F.col("before") - F.col("after")))


def _long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns]) \
             .unpivot([], list(columns), "feature", "value")


def describe_percentiles(features: DataFrame, columns=NUMERIC_FEATURES) -> DataFrame:
    """Op 61: the sigma-point percentiles, one row per feature."""
    return exact_percentiles(_long_form(features, columns), ["feature"], "value",
                             K.SIGMA_PERCENTILES, K.SIGMA_PERCENTILE_NAMES)


def _describe(long_df: DataFrame, groups, probs, names) -> DataFrame:
    v = F.when(~F.isnan("value"), F.col("value"))
    basic = long_df.groupBy(*groups).agg(
        F.count(v).alias("count"),
        F.round(F.avg(v), 6).alias("mean"),
        F.round(F.stddev_samp(v), 6).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    pct = exact_percentiles(long_df, groups, "value", probs, names)
    return basic.join(pct, list(groups), "left")


def describe_column(features: DataFrame, column: str = "potential_fr_accent_issues") -> DataFrame:
    """Op 62: count, mean, sample std, min, chosen percentiles with the median, max."""
    long_df = _long_form(features, [column])
    return _describe(long_df, ["feature"], K.DESCRIBE_COLUMN_PERCENTILES, K.DESCRIBE_COLUMN_PERCENTILE_NAMES)


def describe_all(features: DataFrame, columns=NUMERIC_FEATURES) -> DataFrame:
    """Op 63: the default describe (quartiles) of every numeric column."""
    return _describe(_long_form(features, columns), ["feature"],
                     K.DESCRIBE_DEFAULT_PERCENTILES, K.DESCRIBE_DEFAULT_PERCENTILE_NAMES)


def similarity_histogram(df: DataFrame, col: str = "similarity", bins: int = K.HISTOGRAM_BINS) -> DataFrame:
    """Op 64: numpy's histogram: equal-width bins from min to max, a value falls between the edges that
    enclose it, the last bin is closed; a single-valued column spans half a unit to either side. Empty bins
    are reported with 0. The two bounds are one small aggregate, passed on as literals."""
    x = F.col(col)
    mn, mx = df.agg(F.min(x), F.max(x)).first()
    if mn is None:
        mn, mx = 0.0, 1.0
    elif mn == mx:
        mn, mx = mn - 0.5, mx + 0.5
    step = (mx - mn) / bins
    edges = [i * step + mn for i in range(bins)] + [mx]
    # the bin is the number of inner edges that are not above the value
    bin_of = reduce(lambda a, b: a + b, [(x >= F.lit(float(e))).cast("int") for e in edges[1:-1]], F.lit(0))
    counts = df.where(x.isNotNull()).groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    table = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(float(edges[i])).alias("lower"), F.lit(float(edges[i + 1])).alias("upper"))
                      for i in range(bins)])
    listed = df.sparkSession.range(1).select(F.inline(table))
    return (listed.join(counts, "bin", "left")
                  .select("bin", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"),
                          F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def outlier_counts(features: DataFrame, criteria=K.OUTLIER_CRITERIA, feats=K.FEATURES) -> DataFrame:
    """Op 65: per tier and feature, rows strictly below low and strictly above high (all rows)."""
    aggs = []
    for tier, bounds in criteria.items():
        for f in feats:
            lo, hi = bounds[f]
            aggs.append(F.struct(F.lit(tier).alias("tier"), F.lit(f).alias("feature"),
                                 F.count_if(F.col(f) < lo).alias("n_below"),
                                 F.count_if(F.col(f) > hi).alias("n_above")))
    row = features.agg(F.array(*aggs).alias("r"))
    return row.select(F.inline("r"))


def gate_metrics(threshold: float = K.KEEP_ABOVE_SIMILARITY) -> dict[str, Column]:
    """Ops 66 and 67 as metrics of the gate's own write: what ``exclusion_summary`` and ``kept_fraction`` count."""
    sums = {c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).cast("long") for c in K.EXCLUSION_COLUMNS + ["exclude"]}
    return {"n_total": F.count(F.lit(1)), "n_kept": F.count_if(~F.col("exclude")),
            "n_above_threshold": F.count_if(F.col("similarity") > threshold), **sums}


def exclusion_summary(gated: DataFrame) -> DataFrame:
    """Op 66: column sums of the eleven exclusion columns and ``exclude``; the accent one sums counts."""
    aggs = []
    for c in K.EXCLUSION_COLUMNS + ["exclude"]:
        val = F.col(c) if c == "potential_fr_accent_issues" else F.col(c).cast("long")
        aggs.append(F.coalesce(F.sum(val), F.lit(0)).cast("long").alias(c))
    return gated.agg(*aggs)


def kept_fraction(gated: DataFrame, threshold: float = K.KEEP_ABOVE_SIMILARITY) -> DataFrame:
    """Op 67: rows kept and their share; rows strictly above a similarity threshold and their share."""
    return gated.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(~F.col("exclude")).alias("n_kept"),
        F.count_if(F.col("similarity") > threshold).alias("n_above_threshold"),
    ).withColumns({
        "kept_share": F.round(F.try_divide(F.col("n_kept"), F.col("n_total")), 6),
        "above_threshold_share": F.round(F.try_divide(F.col("n_above_threshold"), F.col("n_total")), 6),
    })
