"""SimHash near-duplicates by multi-index hashing.

Fingerprint: the text's A-Z are lower-cased, its words are runs of anything but ASCII white space, its
shingles all runs of ``shingle`` words (repeats included; fewer words: the whole sequence), joined by one
space. Each shingle has a 64-bit XXH64 (seed 42); a fingerprint bit is 1 if more than half of the
shingles have it. No words: fingerprint zero, linked like any other.

Search: the 64-bit code is cut into two 32-bit segments, and a table has every distinct code under the value of
each. Two codes within 2 bits differ in at most one bit of the upper segment, or not at all in the lower
one. So a query code fetches the codes with its own lower value, with its own upper value, and with the upper values
of the ball of one bit around it (only the values that add a bit: the other code fetches the rest), and
verifies complete distances. For 1 bit both segments are fetched by their own values alone.

A value that more than ``HOT`` codes share is split by the other segment: its codes are listed under that
segment's ball of one bit, at most 33 codes an entry, so no bucket lists its pairs. Codes that share the hot value and
are within 2 bits meet in an entry, which links its members to the smallest; a query whose value is one bit
away, and may then differ in one more, fetches the one entry with its own other segment.

Exact copies share a code and are one node; components are taken over distinct codes and joined back.

Edge cases: null, empty and white-space-only texts have fingerprint zero. A null id never is a
component's id; a component without any id has a null one. Repeated rows are kept, each with its result. A very long
text is hashed whole (8 bytes a word, bits counted 50,000 shingles at a time). An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from ..session import materialize
from .arrow import append_columns
from .components import component_labels

#: Bits of a segment, and codes of a segment's value beyond which it is split by the other segment.
SEGMENT, HOT = 32, 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one text, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    hashes = np.fromiter([digest(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[shingle - 1:].tolist())], np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 50_000):
        ones += np.unpackbits(hashes[i:i + 50_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(df: DataFrame, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``df`` with ``simhash``, the fingerprint as a signed 64-bit integer. No shuffle."""
    def run(texts):
        return {"simhash": np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)}
    return append_columns(df, text_col, [StructField("simhash", LongType())], run)


def links(codes: DataFrame, max_distance: int = 2) -> DataFrame:
    """Verified links (a, b) between distinct codes (column ``code``): enough of them to connect every
    pair within ``max_distance`` bits."""
    if max_distance not in (0, 1, 2):
        raise ValueError("max_distance is 0, 1 or 2: larger ones need larger balls")
    if max_distance == 0:
        return codes.select(F.col("code").alias("a"), F.col("code").alias("b")).limit(0)
    low = (1 << SEGMENT) - 1
    upper, lower = F.shiftrightunsigned("code", SEGMENT), F.col("code").bitwiseAND(F.lit(low))
    entry = lambda segment, value, other: F.struct(F.lit(segment).alias("segment"), value.alias("value"), other.alias("other"))
    table = codes.select("code", F.inline(F.array(entry(0, upper, lower), entry(1, lower, upper))))
    hot = table.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).drop("n").withColumn("hot", F.lit(True))
    table = materialize(table.join(hot, ["segment", "value"], "left").na.fill(False, ["hot"]), "simhash-table")
    # queries: a code's own value in each segment, and the upper values with one bit more
    bits = F.array(*[F.lit(1 << b) for b in range(SEGMENT)])
    more = F.filter(F.transform(bits, lambda b: upper.bitwiseOR(b)), lambda v: v != upper) if max_distance == 2 else F.array().cast("array<long>")
    ball = codes.select(F.col("code").alias("a"), F.explode(more).alias("value"), lower.alias("other")).withColumn("segment", F.lit(0))
    own = table.select(F.col("code").alias("a"), "segment", "value", "other")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("code"))) <= max_distance
    # Spark sizes what is exploded, or read from these well packed files, far too low: none of it may be broadcast
    own, ball = own.hint("merge"), ball.hint("merge")
    cold = table.where("not hot").select("segment", "value", "code")
    found = [own.join(cold, ["segment", "value"]).where((F.col("a") < F.col("code")) & near), ball.join(cold, ["segment", "value"]).where(near)]
    # hot values: their codes under the other segment's ball
    around = F.concat(F.array("other"), F.transform(bits, lambda b: F.col("other").bitwiseXOR(b)))
    split = table.where("hot").select("segment", "value", "code", "other", F.explode(around).alias("meet"))
    if max_distance == 2:  # all members of an entry are linked: each to the smallest
        least = F.min("code").over(Window.partitionBy("segment", "value", "meet"))  # at most 33 rows
        found.append(split.select(least.alias("a"), "code").where((F.col("a") != F.col("code")) & near))
    else:  # those one bit from a code that is there itself
        found.append(own.withColumnRenamed("other", "meet").join(split, ["segment", "value", "meet"]).where((F.col("a") < F.col("code")) & near))
    met = split.where("segment = 0").select("segment", "value", "code", F.col("meet").alias("other"))
    found.append(ball.join(met, ["segment", "value", "other"]).where(near))
    return reduce(DataFrame.union, [x.select("a", F.col("code").alias("b")) for x in found]).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """One row per row of ``df``: ``id``, ``digest`` (of the text), ``simhash`` and ``component_id`` (the smallest
    id of the documents reachable by links)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))
    rows = materialize(with_fingerprint(rows, "text", shingle).drop("text"), "simhash")
    codes = materialize(rows.groupBy(F.col("simhash").alias("code")).agg(F.min("id").alias("least")), "simhash-codes")
    labels = component_labels(links(codes.select("code"), max_distance))
    labelled = codes.join(labels, F.col("code") == F.col("node"), "left") \
                    .select("code", "least", F.coalesce("label", "code").alias("label"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = materialize(labelled.join(least, "label").select(F.col("code").alias("simhash"), "component_id"), "simhash-components")
    return rows.join(named, "simhash").select("id", "digest", "simhash", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id (null ids last; then the
    smallest text digest, then the smallest of the other columns, read as text)."""
    found = near_duplicates(df, id_col, text_col, shingle, max_distance)
    # a group without any id is told apart by its component's codes, which only then stand in for the id
    group = F.coalesce(F.col("component_id").cast("string"), F.lit(""))
    first = found.groupBy(group.alias("g"), F.when(F.col("component_id").isNull(), F.col("simhash")).alias("own")) \
                 .agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "digest")).alias("k")).select("k.id", "k.digest")
    key = lambda i, d: F.xxhash64(i.isNull(), i, d)  # noqa: E731  one key: the window below reuses the join's partitioning
    d = df.withColumn("__digest", F.xxhash64(F.col(text_col))).withColumn("__key", key(F.col(id_col), F.col("__digest"))).alias("d")
    k = first.select("id", "digest", key(F.col("id"), F.col("digest")).alias("__key")).alias("k")
    kept = d.join(k, (F.col("d.__key") == F.col("k.__key")) & F.col(f"d.{id_col}").eqNullSafe(F.col("k.id"))
                  & (F.col("d.__digest") == F.col("k.digest"))).select("d.*")
    others = [F.col(f"`{c}`").cast("string") for c in df.columns if c not in (id_col, text_col)]
    place = F.row_number().over(Window.partitionBy("__key", id_col, "__digest").orderBy(*(others or [F.lit(0)])))
    return kept.withColumn("__place", place).where("__place = 1").drop("__place", "__digest", "__key")
