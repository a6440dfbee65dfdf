"""Dense, gap-free 0-based ordinals in a global sort order, without a single-partition window.

``row_number() OVER (ORDER BY ...)`` with no partition moves every row into one task. Instead:

1. range-partition on (groups..., order...) and sort inside each partition;
2. tag rows with ``monotonically_increasing_id`` (partition index in the high bits, position in
   the partition in the low bits) and write the tagged rows to the shared checkpoint folder, which
   pins the tags for the two reads below (and for task retries);
3. per (partition, group): first tag and row count; since groups lead the range key, a partition
   holds a contiguous run of groups, so this table has at most partitions + groups rows and is
   broadcast (checked against a row bound);
4. a running sum over that small table gives each (partition, group) its offset;
5. ordinal = offset + (tag - first tag).

The sort key must be a total order (ties broken by a unique column) so results are deterministic.
A hot value cannot skew step 1 because the unique tiebreaker lets the range partitioner split it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .sizing import broadcast_if_small

_LOW_BITS = 33


def with_ordinal(df: DataFrame, order: Sequence[Column | str], out_col: str = "ordinal",
                 groups: Sequence[str] = (), num_partitions: int | None = None) -> DataFrame:
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    group_cols = [F.col(g) for g in groups]
    # without an explicit count the range exchange follows spark.sql.shuffle.partitions and AQE
    # may coalesce it; the ordinals do not depend on the partition count
    if num_partitions:
        ranged = df.repartitionByRange(num_partitions, *group_cols, *order_cols)
    else:
        ranged = df.repartitionByRange(*group_cols, *order_cols)
    ranged = ranged.sortWithinPartitions(*group_cols, *order_cols) \
                   .withColumn("_tag", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ordinal")
    stats = (ranged.groupBy(F.shiftright(F.col("_tag"), _LOW_BITS).alias("_part"), *group_cols)
                   .agg(F.min("_tag").alias("_first"), F.count(F.lit(1)).alias("_n")))
    w = Window.partitionBy(*group_cols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(stats.withColumn("_base", F.coalesce(F.sum("_n").over(w), F.lit(0))), "ordinal-offsets")
    keys = [F.shiftright(F.col("r._tag"), _LOW_BITS) == F.col("o._part")] + [F.col(f"r.{g}").eqNullSafe(F.col(f"o.{g}")) for g in groups]
    # at most (partitions + groups) rows: broadcast unless a caller ranks within millions of groups
    joined = ranged.alias("r").join(broadcast_if_small(offsets, 1_000_000).alias("o"), on=keys, how="inner")
    return joined.select(
        *[F.col(f"r.{c}") for c in df.columns],
        (F.col("o._base") + F.col("r._tag") - F.col("o._first")).alias(out_col),
    )


def with_running_total(df: DataFrame, order: Sequence[Column | str], value_col: str, out_col: str,
                       groups: Sequence[str] = ()) -> DataFrame:
    """``out_col``: the sum of ``value_col`` over the rows before this one in the order of its group. The same
    range sort as ``with_ordinal``; a partition's rows are summed by a window over (partition, group), the
    partitions' totals by one over a table with a row per (partition, group)."""
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    group_cols = [F.col(g) for g in groups]
    ranged = df.repartitionByRange(*group_cols, *order_cols).sortWithinPartitions(*group_cols, *order_cols) \
               .withColumn("_tag", F.monotonically_increasing_id())
    ranged = materialize(ranged, "running").withColumn("_part", F.shiftright(F.col("_tag"), _LOW_BITS))
    before = Window.partitionBy("_part", *group_cols).orderBy("_tag").rowsBetween(Window.unboundedPreceding, -1)
    inner = ranged.withColumn("_inner", F.coalesce(F.sum(value_col).over(before), F.lit(0)))
    stats = ranged.groupBy("_part", *group_cols).agg(F.sum(value_col).alias("_n"))
    w = Window.partitionBy(*group_cols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(stats.withColumn("_base", F.coalesce(F.sum("_n").over(w), F.lit(0))), "running-offsets")
    keys = [F.col("r._part") == F.col("o._part")] + [F.col(f"r.{g}").eqNullSafe(F.col(f"o.{g}")) for g in groups]
    joined = inner.alias("r").join(broadcast_if_small(offsets, 1_000_000).alias("o"), on=keys, how="inner")
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("o._base") + F.col("r._inner")).alias(out_col))
