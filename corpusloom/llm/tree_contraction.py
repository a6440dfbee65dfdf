"""Subtree totals of a forest by parallel tree contraction, as DataFrame jobs.

Every round rakes and compresses. Rake: all leaves give their total to their parent and go. Compress: of each
chain of nodes with a single child those go that come before both neighbours in a fixed order, so never two
neighbours and always a share of the chain; the child is hung to the node above and carries what the missing
node would have added. A round leaves a written table with the rows that are left (a path of n nodes takes about
log n rounds, as does a tree of any shape), so sizes fall geometrically and a lost executor costs one round.

The rounds are then re-expanded from last to first: the total of a node that was compressed is what it held, and
the total of its child, which went later and is known by then.

A node with very many children is a hot key only in sums by parent, which are pre-aggregated, and in plain
joins from child to parent, whose hot side Spark splits. The driver sees one row count a round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def subtree_totals(nodes: DataFrame, values: list[str], order: Column | None = None) -> DataFrame:
    """``node`` and, for each of ``values``, its sum over the node and all below it. ``nodes`` has ``node`` (unique,
    not null, any comparable type), ``parent`` (null for a root) and ``values`` (integers). ``order`` says which nodes of
    a chain go first; by default a hash of the node. An empty table gives no rows."""
    own, up = [f"a_{v}" for v in values], [f"e_{v}" for v in values]
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("k")).where("node is not null")
    place = F.struct(*([order] if order is not None else []), F.xxhash64("node"), "node")
    live = nodes.join(children, "node", "left").select(
        "node", "parent", F.coalesce("k", F.lit(0).cast("long")).alias("k"), place.alias("place"),
        *[F.col(v).cast("long").alias(a) for v, a in zip(values, own)], *[F.lit(0).cast("long").alias(e) for e in up])
    raked, compressed = [], []
    while True:
        # rake: a round's table has the leaves, which go, and the others with what the leaves gave them
        given = live.where("k = 0 and parent is not null").groupBy(F.col("parent").alias("node")).agg(
            F.count(F.lit(1)).alias("gone"), *[F.sum(F.col(a) + F.col(e)).alias(f"g_{a}") for a, e in zip(own, up)])
        table = materialize(live.join(given, "node", "left").select(
            "node", "parent", (F.col("k") == 0).alias("leaf"), (F.col("k") - F.coalesce("gone", F.lit(0))).alias("k"), "place",
            *[(F.col(a) + F.coalesce(f"g_{a}", F.lit(0))).alias(a) for a in own], *up), "tree-raked")
        raked.append(table.where("leaf").select("node", *own))
        rest = table.where("not leaf").drop("leaf").withColumn("single", F.expr("k = 1 and parent is not null"))
        if rest.isEmpty():
            return _expand(raked, compressed, own, values)
        # compress: of the nodes with one child, those that come before their single neighbours
        above = rest.where("single").select(F.col("node").alias("parent"), F.col("place").alias("above"))
        mids = rest.where("single").join(above, "parent", "left") \
                   .where("above is null or place < above").select(F.col("node").alias("mid"), F.col("parent").alias("top"), "place", *own, *up)
        low = rest.select(F.col("node").alias("child"), F.col("parent").alias("mid"), F.when(F.col("single"), F.col("place")).alias("below"), *[F.col(e).alias(f"c_{e}") for e in up])
        gone = materialize(low.join(mids, "mid").where("below is null or place < below").select(
            "mid", "child", "top", *[(F.col(a) + F.col(f"c_{e}")).alias(a) for a, e in zip(own, up)],
            *[F.col(e) for e in up], *[(F.col(a) + F.col(e) + F.col(f"c_{e}")).alias(f"n_{e}") for a, e in zip(own, up)]), "tree-compressed")
        compressed.append(None if gone.isEmpty() else gone.select(F.col("mid").alias("node"), "child", *own))
        live = rest.drop("single")
        if compressed[-1] is not None:
            change = gone.select(F.col("child").alias("node"), F.lit(False).alias("goes"), "top", *[f"n_{e}" for e in up]).union(
                gone.select("mid", F.lit(True), "top", *up))
            live = live.join(change, "node", "left").where("goes is null or not goes").select(
                "node", F.when(F.col("goes").isNull(), F.col("parent")).otherwise(F.col("top")).alias("parent"), "k", "place", *own,
                *[F.coalesce(f"n_{e}", e).alias(e) for e in up])


def _expand(raked: list[DataFrame], compressed: list[DataFrame | None], own: list[str], values: list[str]) -> DataFrame:
    known = [raked[-1]]
    for leaves, gone in zip(reversed(raked[:-1]), reversed(compressed)):
        if gone is not None:
            later = reduce(DataFrame.union, known).select(F.col("node").alias("child"), *[F.col(a).alias(f"t_{a}") for a in own])
            known.append(materialize(gone.join(later, "child").select("node", *[(F.col(a) + F.col(f"t_{a}")).alias(a) for a in own]), "tree-expanded"))
        known.append(leaves)
    return reduce(DataFrame.union, known).select("node", *[F.col(a).alias(v) for a, v in zip(own, values)])
