"""Exact, linearly interpolated percentiles without collecting a group into one task.

Spark's exact ``percentile`` aggregate keeps a value->count map per group, so a group holding most
of the data lands in one task's memory. The value wanted for probability p is

    h = (n - 1) * p,  lo = floor(h),  hi = ceil(h),  q = x[lo] + (h - lo) * (x[hi] - x[lo])

(pandas' default ``linear`` method and DuckDB's ``quantile_cont``); missing values and NaN are skipped.

Groups proven small by a count (at most AGGREGATE_MAX_ROWS_PER_GROUP values) use Spark's exact
``percentile`` aggregate. Larger groups use the bracket strategy (no global sort of the data):

1. one aggregate per group: the row count and a ``percentile_approx`` sketch (bounded memory) at
   p -/+ a margin of a few times the sketch's rank error, which brackets each wanted rank;
2. one counting pass: rows strictly below each bracket and rows up to its upper end;
3. only the rows inside a bracket (about 6 n / accuracy per percentile) are ranked exactly with the
   distributed ordinals of ``operators.ordinal``; rank = rows below + position in the bracket. A
   bracket whose two ends are one value (a value repeated many times) gives the answer directly;
4. if any wanted rank falls outside its bracket (the sketch's guarantee failed), the whole input is
   ranked instead, so the result is exact either way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordinal import with_ordinal
from .sizing import broadcast_if_small

SKETCH_ACCURACY = 10000
# groups of at most this many values use Spark's exact ``percentile`` aggregate directly (its
# value->count map then holds at most this many entries per group); larger groups take the sketch path
AGGREGATE_MAX_ROWS_PER_GROUP = 1_000_000
# per-group summary tables (one row per group and percentile) are broadcast up to this size
TARGETS_BROADCAST_MAX_ROWS = 1_000_000


def exact_percentiles(df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float],
                      names: Sequence[str], digits: int | None = 6,
                      accuracy: int = SKETCH_ACCURACY, method: str = "auto") -> DataFrame:
    """``method``: "auto" (size check), "aggregate" (Spark's exact percentile; small groups only) or
    "sketch" (the bracket method, for groups of any size)."""
    groups = list(groups)
    keys = groups or ["_all"]
    vals = df.select(*groups, F.col(value).cast("double").alias("_v")) \
             .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if not groups:
        vals = vals.withColumn("_all", F.lit(0))
    if method == "auto":
        largest = vals.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        method = "aggregate" if largest <= AGGREGATE_MAX_ROWS_PER_GROUP else "sketch"
    if method == "aggregate":
        q = F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs]))
        out = vals.groupBy(*keys).agg(q.alias("_qs"))
        cols = [(_rounded(F.col("_qs")[i], digits) if digits is not None else F.col("_qs")[i]).alias(nm)
                for i, nm in enumerate(names)]
        out = out.select(*keys, *cols)
        return out.drop("_all") if not groups else out

    targets = _targets(vals, keys, probs, names, accuracy)
    counts = (vals.join(targets, keys, "inner")
                  .groupBy(*keys, "_name")
                  .agg(F.count_if(F.col("_v") < F.col("_blo")).alias("_below"),
                       F.count_if(F.col("_v") <= F.col("_bhi")).alias("_upto")))
    plan = materialize(targets.join(counts, [*keys, "_name"], "left").na.fill(0, ["_below", "_upto"]),
                       "percentile-plan")
    contained = (F.col("_below") <= F.col("_lo")) & (F.col("_hi") < F.col("_upto"))
    if plan.where(~contained).limit(1).count() > 0:
        ranked_all = with_ordinal(vals.withColumn("_uid", F.monotonically_increasing_id()),
                                  order=["_v", "_uid"], groups=keys, out_col="_rank")
        out = _interpolate(ranked_all.select(*keys, "_rank", "_v"), targets, keys, [])
    else:
        # a bracket whose two ends are the same value pins the answer: no rows to rank
        pinned = targets.where(F.col("_blo") == F.col("_bhi"))
        pinned_q = pinned.select(*keys, "_name", F.col("_blo").alias("_q"))
        open_targets = targets.where(F.col("_blo") != F.col("_bhi"))
        inside = (vals.join(open_targets, keys, "inner")
                      .where(F.col("_v").between(F.col("_blo"), F.col("_bhi")))
                      .select(*keys, "_name", "_v")
                      .withColumn("_uid", F.monotonically_increasing_id()))
        # the unique tiebreaker lets the range partitioner split a value repeated many times
        ranked = with_ordinal(inside, order=["_v", "_uid"], groups=[*keys, "_name"], out_col="_pos")
        ranked = (ranked.join(plan.select(*keys, "_name", "_below"), [*keys, "_name"], "inner")
                        .select(*keys, "_name", (F.col("_below") + F.col("_pos")).alias("_rank"), "_v"))
        out = _interpolate(ranked, open_targets, keys, ["_name"]).unionByName(pinned_q)
    out = _pivot(out, keys, names, digits)
    return out.drop("_all") if not groups else out


def _rounded(q: Column, digits: int) -> Column:
    """Rounded half up on ten decimal digits, so that a tie doesn't hang on the last bit of the interpolation."""
    return F.round(F.round(q, 10), digits)


def _targets(vals: DataFrame, keys, probs, names, accuracy) -> DataFrame:
    """(keys, _name, _h, _lo, _hi, _blo, _bhi): wanted ranks and the value bracket around them."""
    margin = 3.0 / accuracy
    sketch_probs = []
    for p in probs:
        sketch_probs += [max(0.0, p - margin), min(1.0, p + margin)]
    summary = vals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", F.array(*[F.lit(float(q)) for q in sketch_probs]), accuracy).alias("_qs"))
    rows = []
    for i, (name, p) in enumerate(zip(names, probs)):
        # at the ends of the range the bracket is open, so the first/last rank is always inside
        blo = F.lit(float("-inf")) if p - margin <= 0 else F.col("_qs")[2 * i]
        bhi = F.lit(float("inf")) if p + margin >= 1 else F.col("_qs")[2 * i + 1]
        rows.append(F.struct(F.lit(name).alias("_name"), F.lit(float(p)).alias("_p"),
                             blo.alias("_blo"), bhi.alias("_bhi")))
    t = summary.select(*keys, "_n", F.explode(F.array(*rows)).alias("_t")).select(*keys, "_n", "_t.*")
    h = (F.col("_n") - 1) * F.col("_p")
    t = t.select(*keys, "_name", h.alias("_h"), F.floor(h).cast("long").alias("_lo"),
                 F.ceil(h).cast("long").alias("_hi"), "_blo", "_bhi")
    # written once: every later step reads this small table instead of re-running the sketch pass
    return broadcast_if_small(materialize(t, "percentile-targets"), TARGETS_BROADCAST_MAX_ROWS)


def _interpolate(ranked: DataFrame, targets: DataFrame, keys, extra_keys) -> DataFrame:
    """Fetch the values at the two neighbouring ranks of every target and interpolate."""
    ends = targets.select(*keys, "_name", "_h", "_lo",
                          F.explode(F.array(F.col("_lo"), F.col("_hi"))).alias("_rank")).distinct()
    picked = ends.join(ranked, [*keys, *extra_keys, "_rank"], "inner")
    per_target = (picked.groupBy(*keys, "_name")
                        .agg(F.max(F.when(F.col("_rank") == F.col("_lo"), F.col("_v"))).alias("_a"),
                             F.max(F.when(F.col("_rank") != F.col("_lo"), F.col("_v"))).alias("_b"),
                             F.first("_h").alias("_h"), F.first("_lo").alias("_lo")))
    frac = F.col("_h") - F.col("_lo")
    q = F.col("_a") + frac * (F.coalesce(F.col("_b"), F.col("_a")) - F.col("_a"))
    return per_target.select(*keys, "_name", q.alias("_q"))


def _pivot(per_target: DataFrame, keys, names, digits) -> DataFrame:
    q = F.col("_q") if digits is None else _rounded(F.col("_q"), digits)
    return per_target.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == nm, q)).alias(nm) for nm in names])
