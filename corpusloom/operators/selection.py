"""The n rows with the smallest hash, by a threshold instead of a sort (ops 78, 81, 83).

The hash order's n-th place is found by counting: rows per range of the digest (4,096 ranges of the whole, then of the
one range that holds the n-th row, and so on) until that range has at most ``SETTLE`` rows, whose digests settle it
exactly. Each count is one pass over the key and a table of at most 4,096 numbers a group; nothing is sorted,
joined or gathered, and n has no limit. The rows then pass a filter on their own digest.

Rows with equal digests (the same id) are ordered by a hash of all their columns, and only these, if the n-th place
falls among them, get distributed ordinals. A null id's digest is empty and comes first.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinal import with_ordinal

BITS, WHOLE = 12, 60
SETTLE = 10_000


@dataclass(frozen=True)
class Limit:
    """Rows with a digest below ``digest`` are within the first n, and ``among`` of the ``equal`` ones with it."""
    digest: str
    among: int
    equal: int


def _place(digest: Column) -> Column:
    """The digest's first 60 bits as a number."""
    return F.coalesce(F.conv(F.substring(digest, 1, WHOLE // 4), 16, 10).cast("long"), F.lit(0).cast("long"))


def limits(df: DataFrame, digest: Column, wanted: dict[tuple, int], groups: tuple[str, ...] = ()) -> dict[tuple, Limit | None]:
    """For each group (values of ``groups``) the digest where its first n rows end; None if it has no more than n rows.
    Groups are configured ones (a number for each), not ones found in the data."""
    keyed = df.select(*groups, F.coalesce(digest, F.lit("")).alias("_d")).withColumn("_h", _place(F.col("_d")))
    found: dict[tuple, Limit | None] = {}
    open_ranges = {g: (0, 0, n) for g, n in wanted.items() if n > 0}  # bits known, their value, rows still wanted in the range
    found.update({g: Limit("", 0, 0) for g, n in wanted.items() if n <= 0})
    settle: dict[tuple, tuple[int, int, int]] = {}
    while open_ranges:
        # groups whose ranges are at the same depth are counted in one pass
        depth = min(bits for bits, _, _ in open_ranges.values())
        now = {g: r for g, r in open_ranges.items() if r[0] == depth}
        inside = keyed.where(reduce(Column.__or__, [_in_range(groups, g, bits, value) for g, (bits, value, _) in now.items()]))
        counts = inside.groupBy(*groups, F.shiftright("_h", WHOLE - depth - BITS).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
        tables: dict[tuple, dict[int, int]] = {}
        for r in counts.toLocalIterator():
            tables.setdefault(tuple(r[g] for g in groups), {})[r["_b"]] = r["_n"]
        for g, (_, _, n) in now.items():
            del open_ranges[g]
            for bucket, size in sorted(tables.get(g, {}).items()):
                if n <= size:
                    whole = depth + BITS == WHOLE
                    (settle if size <= SETTLE or whole else open_ranges)[g] = (depth + BITS, bucket, n)
                    break
                n -= size
            else:
                found[g] = None
    if settle:
        inside = keyed.where(reduce(Column.__or__, [_in_range(groups, g, bits, value) for g, (bits, value, _) in settle.items()]))
        rows: dict[tuple, list[tuple[str, int]]] = {}
        # at most SETTLE digests a group, or (60 equal bits) one
        for r in inside.groupBy(*groups, "_d").agg(F.count(F.lit(1)).alias("_n")).toLocalIterator():
            rows.setdefault(tuple(r[g] for g in groups), []).append((r["_d"], r["_n"]))
        for g, (_, _, n) in settle.items():
            for d, size in sorted(rows[g]):
                if n <= size:
                    found[g] = Limit(d, n, size)
                    break
                n -= size
    return found


def _in_group(groups: tuple[str, ...], values: tuple) -> Column:
    return reduce(Column.__and__, [F.col(g).eqNullSafe(F.lit(v)) for g, v in zip(groups, values)], F.lit(True))


def _in_range(groups: tuple[str, ...], values: tuple, bits: int, value: int) -> Column:
    inside = _in_group(groups, values)
    return inside & (F.shiftright("_h", WHOLE - bits) == value) if bits else inside


def side_of_limit(df: DataFrame, digest: Column, wanted: dict[tuple, int], groups: tuple[str, ...] = (), out_col: str = "_in") -> DataFrame:
    """``df`` with ``out_col``: whether the row is among its group's first n (``wanted``) by digest; rows of other groups
    are not. Read ``df`` from a written table: it is scanned a few times."""
    own, key = limits(df, digest, wanted, groups), F.coalesce(digest, F.lit(""))
    side, ties = F.lit(False), []
    for values, limit in own.items():
        inside = F.lit(True)
        if limit is not None:
            inside = key <= F.lit(limit.digest) if limit.among == limit.equal and limit.equal else key < F.lit(limit.digest)
            if limit.among < limit.equal:
                ties.append(_in_group(groups, values) & (key == F.lit(limit.digest)))
        side = side | (_in_group(groups, values) & inside)
    out = df.withColumn(out_col, side)
    if not ties:
        return out
    # the n-th place falls among rows with one digest: these few are ranked
    tied = reduce(Column.__or__, ties)
    ranked = with_ordinal(out.where(tied).withColumn("_row", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])),
                          [F.col("_row"), F.monotonically_increasing_id()], "_rank", groups)
    among = reduce(lambda rest, x: F.when(_in_group(groups, x[0]), F.lit(x[1].among)).otherwise(rest),
                   [(g, x) for g, x in own.items() if x is not None], F.lit(0))
    ranked = ranked.withColumn(out_col, F.col("_rank") < among).select(*out.columns)
    return out.where(~tied).unionByName(ranked)


def smallest(df: DataFrame, n: int, digest: Column) -> DataFrame:
    """The ``n`` rows of ``df`` with the smallest digest (all if there are fewer), as rows of ``df`` in no order."""
    return side_of_limit(df, digest, {(): n}).where("_in").drop("_in")
