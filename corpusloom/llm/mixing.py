"""Mixing sources to target weights by weighted fair queueing.

Every source offers its documents in a shuffled order (a hash of id and text), up to ``max_passes``
times over. A document's virtual finish time is its source's cumulative tokens, up to and including the
document, divided by the source's weight. The offers of all sources are sorted by that time and taken
until the next one would exceed the budget (all sources' tokens, unless given). A source that has no
offers left drops out and the others share the rest by weight, which is the resharing that ``targets``
states in closed steps: targets stop at ``max_passes`` times the source's size.

Nothing gathers a source or the whole order in one task. Cumulative sums are taken in two levels: a
source's documents fall into buckets by their hash, bucket sums are accumulated per source, then rows
within a bucket. The global order is a range sort by finish time; running totals per range partition
are combined over a table with one row per partition. Texts never move: only ids, digests and sizes do.

Edge cases: a null text has size 0; documents of size 0 are never taken; a null source is a source, the last in
order; ids may repeat (rows are told apart by the text's digest and a number among equal rows, and equal
rows are interchangeable); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordinal import with_ordinal
from ..session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
ROWS_PER_BUCKET = 2_000


def size(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def targets(sources: DataFrame, budget: int, max_passes: int) -> DataFrame:
    """``sources`` (source, weight, source_size) with ``target``: the budget by weight, targets over
    ``max_passes`` sizes cut to that, the excess reshared by weight until none is above. Each step is one
    aggregate over the source table; two sums reach the driver."""
    most = F.col("source_size") * F.lit(float(max_passes))
    level = -1.0  # words per unit of weight; sources with most <= level * weight are full
    while True:
        full = most <= F.col("weight") * F.lit(level)
        r = sources.agg(F.sum(F.when(full, most)).alias("spent"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not r["open"]:
            break
        raised = (budget - (r["spent"] or 0.0)) / r["open"]
        if raised <= level:
            break
        level = raised
    return sources.withColumn("target", F.least(most, F.col("weight") * F.lit(max(level, 0.0))))


def weights_in_order(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Sources by code point, null last, with repeating weights."""
    ranked = with_ordinal(sizes, [F.col("source").isNull(), F.col("source")], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    return ranked.select("source", "source_size", "n", weight.alias("weight"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = WEIGHTS, max_passes: int = 3, budget: int | None = None, seed: int = 7) -> DataFrame:
    """One row per row of ``df``: ``id``, ``digest`` (of the text), ``source``, ``size``, ``source_size``, ``weight``, ``target``,
    ``copies`` (times taken) and ``taken`` (words). The same rows in any order give the same result."""
    rows = df.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"), F.col(source_col).alias("source"),
                     size(F.col(text_col)).alias("size"))
    # equal rows are one offer with a count until the end
    rows = rows.groupBy("id", "digest", "source", "size").agg(F.count(F.lit(1)).alias("equal"))
    turn = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("id", "digest", "source")]))
    rows = materialize(rows.withColumn("turn", turn), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("equal")).alias("source_size"), F.sum("equal").alias("n"))
    sources = materialize(weights_in_order(sizes, weights), "mix-weights")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget = total if budget is None else budget
    sources = materialize(targets(sources, budget, max_passes), "mix-sources")

    # cumulative tokens of each row within its source and pass, in the shuffled order
    spread = F.ceil(F.col("n") / ROWS_PER_BUCKET)
    bucket = F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32) * spread)
    r, s = rows.alias("r"), F.broadcast(sources).alias("s") if sources.limit(100_001).count() <= 100_000 else sources.alias("s")
    placed = r.join(s, F.col("r.source").eqNullSafe(F.col("s.source"))).select(
        "r.*", "source_size", "weight", "target", bucket.alias("bucket"))
    placed = materialize(placed, "mix-placed")
    # one row per (source, bucket): a source's buckets follow its number of rows
    per_bucket = placed.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("equal")).alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("earlier"))
    p, b = placed.alias("p"), per_bucket.alias("b")
    joined = p.join(b, F.col("p.source").eqNullSafe(F.col("b.source")) & (F.col("p.bucket") == F.col("b.bucket"))).select("p.*", "earlier")
    so_far = Window.partitionBy("source", "bucket").orderBy("turn", "id", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = joined.withColumn("end", F.col("earlier") + F.sum(F.col("size") * F.col("equal")).over(so_far))

    # every offer: one of the equal rows, in one pass
    offers = ends.where("size > 0").select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(max_passes - 1))).alias("pass")).select(
        "*", F.explode(F.sequence(F.lit(1), F.col("equal").cast("int"))).alias("copy"))
    finish = (F.col("pass") * F.col("source_size") + F.col("end") - (F.col("equal") - F.col("copy")) * F.col("size")) / F.col("weight")
    offers = offers.select(finish.alias("finish"), "id", "digest", "source", "pass", "copy", "size")
    order = ["finish", F.col("source").isNull(), "source", "id", "digest", "pass", "copy"]
    sorted_offers = materialize(offers.repartitionByRange(*order).sortWithinPartitions(*order)
                                .withColumn("tag", F.monotonically_increasing_id()), "mix-order")
    part = F.shiftright("tag", 33)
    sums = sorted_offers.groupBy(part.alias("part")).agg(F.sum("size").alias("words")).collect()  # a row per partition
    start, crossing, whole = 0, None, []
    for x in sorted(sums, key=lambda x: x["part"]):
        if start + x["words"] > budget:
            crossing = x["part"]
            break
        start, whole = start + x["words"], [*whole, x["part"]]
    last = whole[-1] if whole else -1
    taken = sorted_offers.where(part <= last)
    if crossing is not None:  # within the one partition that the budget cuts
        within = sorted_offers.where(part == crossing)
        run = F.sum("size").over(Window.partitionBy(part).orderBy("tag").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        taken = taken.union(within.withColumn("run", run).where(F.col("run") + start <= budget).drop("run"))
    copies = taken.groupBy("id", "digest", "source", "copy").agg(F.count(F.lit(1)).alias("copies"))
    e = placed.select("*", F.explode(F.sequence(F.lit(1), F.col("equal").cast("int"))).alias("copy")).alias("e")
    c = copies.alias("c")
    same = [F.col(f"e.{x}").eqNullSafe(F.col(f"c.{x}")) for x in ("id", "digest", "source", "copy")]
    return e.join(c, on=same, how="left").select(
        "e.id", "e.digest", "e.source", "size", "source_size", "weight", "target", F.coalesce("copies", F.lit(0).cast("long")).alias("copies"),
        (F.col("size") * F.coalesce("copies", F.lit(0))).alias("taken"))


def repeat_taken(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it."""
    key = lambda *c: F.xxhash64(*c)  # noqa: E731  one key: the window below reuses the join's partitioning
    m = mix(df, id_col, text_col, source_col, **how).groupBy("id", "digest", "source").agg(
        F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("equal")).where("copies > 0") \
        .withColumn("__key", key("id", "digest", "source")).alias("m")
    d = df.withColumn("__digest", digest(F.col(text_col)))
    d = d.withColumn("__key", key(F.col(id_col), F.col("__digest"), F.col(source_col))).alias("d")
    same = ((F.col("d.__key") == F.col("m.__key")) & F.col(f"d.{id_col}").eqNullSafe(F.col("m.id"))
            & (F.col("d.__digest") == F.col("m.digest")) & F.col(f"d.{source_col}").eqNullSafe(F.col("m.source")))
    joined = d.join(m, same).select("d.*", F.col("copies").alias("__copies"), F.col("equal").alias("__equal"))
    # equal rows share their copies: the first few get one more when the copies don't divide evenly
    number = F.row_number().over(Window.partitionBy("__key", id_col, "__digest", source_col).orderBy(F.lit(0)))
    share = F.floor(F.col("__copies") / F.col("__equal")) + F.when(F.col("__number") <= F.col("__copies") % F.col("__equal"), 1).otherwise(0)
    out = joined.withColumn("__number", number).withColumn("__share", share.cast("int")).where("__share > 0")
    return out.select("*", F.explode(F.sequence(F.lit(1), F.col("__share"))).alias("__n")) \
              .drop("__n", "__copies", "__equal", "__number", "__share", "__key", "__digest")
