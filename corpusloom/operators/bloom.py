"""Bloom filters from bitmap aggregates, for word lists that are too long to broadcast (ops 26, 27, 55).

A word sets ``HASHES`` bits in one bitmap of 32,768 bits, chosen by another hash; ``bitmap_construct_agg`` builds all
bitmaps in one aggregate. They take ``BITS_PER_WORD`` bits a word, so a list of a hundred million words is 150 MB,
where its words would be gigabytes. The bitmaps are broadcast behind a size check; tokens that no bitmap has
are in no list and needn't be shuffled. What is left (all hits and about one in three hundred of the rest) is for an
exact join to settle. A null token is in no list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .sizing import MAX_BROADCAST_MB

BITS_PER_WORD, HASHES = 12, 4
BITMAP_BITS = 32_768


def _bitmap(token: Column, n_bitmaps: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("bitmap"), token), F.lit(n_bitmaps))


def _places(token: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(f"place {j}"), token), F.lit(BITMAP_BITS)) for j in range(HASHES)]


def build(words: DataFrame, col: str = "token") -> tuple[DataFrame, int]:
    """(bitmap number, bits) of the distinct words in ``col``, written, and the number of bitmaps."""
    n = max(1, -(-words.count() * BITS_PER_WORD // BITMAP_BITS))
    bits = words.where(F.col(col).isNotNull()).select(_bitmap(F.col(col), n).alias("_bitmap"), F.explode(F.array(*_places(F.col(col)))).alias("_place"))
    return materialize(bits.groupBy("_bitmap").agg(F.bitmap_construct_agg("_place").alias("_bits")), "bloom"), n


def fits(n_bitmaps: int) -> bool:
    """Whether so many bitmaps may be broadcast."""
    return n_bitmaps * (BITMAP_BITS // 8) <= MAX_BROADCAST_MB << 20


def keep_candidates(tokens: DataFrame, filter_of: tuple[DataFrame, int], col: str = "token", always: Column | None = None) -> DataFrame:
    """The rows of ``tokens`` whose ``col`` may be in the filter's list, and those for which ``always`` holds."""
    bitmaps, n = filter_of
    if not fits(n):
        return tokens
    def bit(place: Column) -> Column:
        byte = F.conv(F.hex(F.substr("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (place % 8).cast("int"))) != 0
    found = reduce(Column.__and__, [bit(p) for p in _places(F.col(col))])
    keep = F.coalesce(found, F.lit(False))
    joined = tokens.withColumn("_bitmap", _bitmap(F.col(col), n)).join(F.broadcast(bitmaps), "_bitmap", "left")
    return joined.where(keep if always is None else keep | always).select(*tokens.columns)


def false_positive_share(tokens: DataFrame, words: DataFrame, col: str = "token") -> float:
    """Of the distinct tokens that aren't in the list, the share that the filter lets through."""
    distinct = tokens.select(col).where(F.col(col).isNotNull()).distinct()
    others = distinct.join(words.select(col), col, "left_anti")
    return keep_candidates(others, build(words.select(col).distinct(), col), col).count() / max(1, others.count())
