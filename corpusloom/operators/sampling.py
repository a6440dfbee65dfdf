"""Deterministic sampling, splitting, shuffling and capping (ops 78-83).

No ``rand()``: every decision is a function of md5(seed:id), so results do not depend on how the
data happens to be partitioned and are the same on every re-run or task retry.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from .ordinal import with_ordinal
from .selection import side_of_limit, smallest

TWO_POW_32 = 4294967296.0


def md5_key(seed, id_col: str | Column, salt: str = "") -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{salt}{seed}:"), c.cast("string")))


def md5_unit(seed, id_col, salt: str = "") -> Column:
    """First 8 hex digits of md5(salt seed:id) / 2^32: a uniform value in [0, 1)."""
    hex8 = F.substring(md5_key(seed, id_col, salt), 1, 8)
    return F.conv(hex8, 16, 10).cast("long").cast("double") / F.lit(TWO_POW_32)


def train_eval_split(df: DataFrame, id_col: str, ratio: float = K.VAL_RATIO, seed=K.SPLIT_SEED) -> DataFrame:
    """Op 81: ``split`` = eval when the record's hash falls below the ratio.

    Keyed on ``record_id`` this matches the original, which splits records, so the two directions
    of one pair may land on opposite sides; pass ``id_col="pair_id"`` to keep both directions of a
    pair on the same side (no leakage between training and evaluation)."""
    return df.withColumn("split", F.when(md5_unit(seed, id_col) < F.lit(ratio), F.lit("eval"))
                                    .otherwise(F.lit("train")))


def train_eval_split_exact(df: DataFrame, id_col: str, ratio: float = K.VAL_RATIO, seed=K.SPLIT_SEED,
                           out_col: str = "split") -> DataFrame:
    """Op 81, exact-size variant: eval = the ceil(n * ratio) records with the smallest md5(seed:id)
    (the size a dataset library's ``test_size`` gives), found by a threshold on the digest: no sort and no join.
    Rows are split, not ids: rows with a null or repeated id stay as they are (a null id's come first), each on one
    side; ``df`` is read a few times."""
    k = math.ceil(df.count() * ratio)
    taken = side_of_limit(df, md5_key(seed, id_col), {(): k}, out_col="_eval")
    return taken.withColumn(out_col, F.when(F.col("_eval"), F.lit("eval")).otherwise(F.lit("train"))).drop("_eval")


def seeded_shuffle(df: DataFrame, id_col: str, seed=K.SPLIT_SEED, groups=("split",)) -> DataFrame:
    """Op 82: 0-based ``position`` in a seeded order inside each group, via a distributed sort."""
    keyed = df.withColumn("_shuffle_key", md5_key(seed, id_col, salt="shuffle:"))
    out = with_ordinal(keyed, order=["_shuffle_key", id_col], groups=list(groups), out_col="position")
    return out.drop("_shuffle_key")


def cap_rows(shuffled: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Op 83: keep the first N positions of each split (all rows when the split is smaller)."""
    cond = F.lit(False)
    for split, n in caps.items():
        cond = cond | ((F.col("split") == split) & (F.col("position") < n))
    return shuffled.where(cond)


def cap_rows_per_model(split_records: DataFrame, id_col: str, caps: dict[str, int], models=K.MODEL_REGISTRY,
                       seed=K.SPLIT_SEED) -> DataFrame:
    """Ops 50, 82, 83 in the order of the original, for every model: its language's records, shuffled within
    each split, the first N of each. (model, ids and split, position). Models with the same restriction see
    the same order, so records are ranked once per restriction and fanned out to models after the cap."""
    from .prep import registry_entries
    restrictions = sorted({m["restrict_source_language"] or "" for m in models})
    matching = F.filter(F.array(*[F.lit(x) for x in restrictions]), lambda x: (x == "") | (x == F.col("source_lang")))
    records = split_records.select(id_col, "split", F.explode(matching).alias("_only"))
    wanted = {(only, split): n for only in restrictions for split, n in caps.items()}
    # a threshold on the shuffle's digest finds the first N of each; only these are ranked
    first = side_of_limit(records, md5_key(seed, id_col, "shuffle:"), wanted, ("_only", "split")).where("_in").drop("_in")
    ranked = seeded_shuffle(first, id_col, seed, groups=("_only", "split"))
    kept = ranked.select("*", F.explode(registry_entries(models)).alias("_m"))
    return kept.where(F.coalesce("_m.restrict_source_language", F.lit("")) == F.col("_only")) \
               .select(F.col("_m.model").alias("model"), id_col, "split", "position")


def sample_rows(df: DataFrame, n: int, id_col: str, seed=K.SPLIT_SEED, lang: str | None = None,
                lang_col: str = "source_lang", split: str | None = None) -> DataFrame:
    """Op 78: the first n rows in md5 order (all rows if fewer), by a threshold on the digest: no sort, any n. With
    ``split`` only rows of that split (column ``split``) are drawn."""
    if split is not None:
        df = df.where(F.col("split") == split)
    if lang is not None:
        df = df.where(F.col(lang_col) == lang)
    return smallest(df, n, md5_key(seed, id_col, "sample:"))


def sample_band(df: DataFrame, n: int, lo: float, hi: float, id_col: str = "pair_id", seed=K.SPLIT_SEED,
                col: str = "similarity") -> DataFrame:
    """Op 79: up to n rows with lo <= similarity <= hi, sorted by similarity."""
    inside = df.where(F.col(col).between(F.lit(lo), F.lit(hi)))
    return sample_rows(inside, n, id_col, seed).orderBy(col, id_col)


def sample_per_band(df: DataFrame, n: int, start: int = 70, stop: int = 100, step: int = 5,
                    id_col: str = "pair_id", seed=K.SPLIT_SEED, col: str = "similarity") -> DataFrame:
    """Op 80: op 79 for every band [x/100, (x+step)/100], x = start, start+step, ... < stop, at once.

    Bands are inclusive on both ends, so a row on a shared boundary is drawn by both bands, as in the
    per-band loop this replaces. Each row generates its (at most three) candidate bands and keeps
    those that contain it: no join. ``row_number() <= n`` lets Spark insert a partial per-band limit
    before the shuffle, so a band is never gathered whole.
    """
    x = F.col(col)
    base = F.floor((x * F.lit(100) - F.lit(start)) / F.lit(step)).cast("int")
    cand = df.where(x.isNotNull()).select("*", F.explode(F.array(base - 1, base, base + 1)).alias("_b"))
    lo = ((F.lit(start) + F.col("_b") * F.lit(step)) / F.lit(100.0))
    hi = ((F.lit(start) + F.col("_b") * F.lit(step) + F.lit(step)) / F.lit(100.0))
    n_bands = (stop - start + step - 1) // step
    banded = (cand.where((F.col("_b") >= 0) & (F.col("_b") < n_bands))
                  .withColumns({"band_lo": lo, "band_hi": hi})
                  .where(x.between(F.col("band_lo"), F.col("band_hi")))
                  .drop("_b"))
    w = Window.partitionBy("band_lo", "band_hi").orderBy(md5_key(seed, id_col, "sample:"), F.col(id_col))
    return banded.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
