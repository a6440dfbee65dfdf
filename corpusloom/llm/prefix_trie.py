"""Conversation prefix trie: a node for every distinct sequence of first turns, with totals of its subtree.

1. A turn is known by a digest of role and text. The digests of a conversation's first d turns, each hashed with
   its place, are joined by exclusive or to the 128-bit key of that prefix; its parent's key is the same without
   the last turn. Rows are range-sorted by (conversation, place) and a task streams through its own; the keys at
   the seams are put right from one row a partition, so a conversation of any length is spread over tasks.
2. Equal keys are one node: one pre-aggregated grouping gives its members and smallest member. Conversations
   that end in a node are range-sorted too, packed to pieces of text, and hashed in order piece by piece.
3. Totals over subtrees come from tree contraction (``tree_contraction.py``), with the places' lowest set bits as
   the order in chains, so that a chain halves in a round.

Edge cases: turns are ordered by ``turn`` (null first), equal ones by their digest; repeated rows are turns of their
own. Null role or text is empty. Rows without conv_id belong to no conversation and are left out. A conversation
without turns is a member of the root alone. An empty table has no nodes. A text of any length is hashed
where it lies; only digests are sorted. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordinal import with_ordinal
from ..session import materialize
from .tree_contraction import subtree_totals

WORDS = r"[^\x20\x09-\x0D]+"
#: Characters of a packed piece of conv_ids.
PIECE = 60_000


def turns(df: DataFrame) -> DataFrame:
    """(conv_id, place from 0, turn digest, words) of every row that has a conv_id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = df.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"))
    return with_ordinal(rows, [F.col("turn").asc_nulls_first(), "digest", "row"], "place", ["conv_id"]).select("conv_id", "place", "digest", "words")


def rebuilt(df: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation c begins with the first h turns of c - c % ``every``, if there are any,
    and goes on with its own after the first h; h = crc32(c) % ``heads``."""
    rows = materialize(turns(df), "turns")
    h, source = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads, F.col("conv_id") - F.col("conv_id") % every
    rows = rows.withColumn("h", h).withColumn("source", source)
    convs = rows.select("conv_id", "h", "source").distinct()
    lent = rows.where((F.col("conv_id") == F.col("source")) & (F.col("place") < heads - 1)).select("source", "place", "digest", "words")
    size = lent.groupBy("source").agg(F.count(F.lit(1)).alias("lent"))
    first = convs.join(lent, "source").where("place < h").select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "words")
    own = rows.where("place >= h").join(size, "source", "left").select(
        "conv_id", (F.col("place") - F.col("h") + F.least("h", F.coalesce("lent", F.lit(0))) + 1).alias("depth"), "digest", "words")
    return materialize(first.union(own), "rebuilt"), convs.select("conv_id")


def prefixes(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, depth from 1, digest, words) with the keys of each prefix and of the one before it."""
    spark = rows.sparkSession
    term = lambda i: F.xxhash64(F.lit(i), "depth", "digest")
    ranged = rows.withColumn("t1", term(1)).withColumn("t2", term(2)).drop("digest") \
                 .repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry = TaskContext.get().partitionId(), None, [0, 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            size, keys = np.diff(np.append(begin, len(conv))), []
            for i, c in enumerate((3, 4)):
                running = np.bitwise_xor.accumulate(batch.column(c).to_numpy())
                before = np.concatenate([[0], running])[begin]
                if conv[0] == last:
                    before[0] ^= carry[i]
                keys.append(running ^ np.repeat(before, size))
            last, carry = conv[-1], [k[-1] for k in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, keys), pa.array(np.full(len(conv), part, np.int32))],
                                             names=[*batch.schema.names, "k1", "k2", "part"])

    keyed = materialize(ranged.mapInArrow(run, "conv_id long, depth long, words long, t1 long, t2 long, k1 long, k2 long, part int"), "prefixes")
    # the last row of each partition: what a conversation brings along into the next one
    ends = keyed.groupBy("part").agg(F.max(F.struct("conv_id", "depth", "k1", "k2")).alias("e")).select("part", "e.*").orderBy("part").collect()
    seams, brought = [], None
    for r in ends:
        if brought:
            seams.append((r.part, *brought))
        same = brought and brought[0] == r.conv_id
        brought = (r.conv_id, r.k1 ^ brought[1], r.k2 ^ brought[2]) if same else (r.conv_id, r.k1, r.k2)
    seam = spark.createDataFrame(seams, "part int, conv_id long, c1 long, c2 long")  # a row per partition at most
    key = lambda i: F.col(f"k{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0)))
    return keyed.join(F.broadcast(seam), ["part", "conv_id"], "left").select(
        "conv_id", "depth", "words", F.struct(key(1).alias("k1"), key(2).alias("k2")).alias("node"),
        F.struct(key(1).bitwiseXOR(F.col("t1")).alias("k1"), key(2).bitwiseXOR(F.col("t2")).alias("k2")).alias("parent"))


def ends_digest(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of ``ends`` (node, conv_id): the SHA-256 of the node's conv_ids in order, comma-joined."""
    ranged = ends.select("node.k1", "node.k2", "conv_id").repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, size, out = None, [], 0, []
        for batch in batches:
            for *key, conv in zip(*[c.to_pylist() for c in batch.columns]):
                if node != key or size > PIECE:
                    if ids:
                        out.append((*node, int(ids[0]), ",".join(ids)))
                    node, ids, size = key, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if len(out) > 1_000:
                yield _rows(out, "k1", "k2", "first", "ids")
                out = []
        if ids:
            out.append((*node, int(ids[0]), ",".join(ids)))
        if out:
            yield _rows(out, "k1", "k2", "first", "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h, out = None, None, []
        for batch in batches:
            for k1, k2, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if node == (k1, k2):
                    h.update(b"," + ids.encode())
                else:
                    if node:
                        out.append((*node, h.hexdigest()))
                    node, h = (k1, k2), hashlib.sha256(ids.encode())
            if len(out) > 1_000:
                yield _rows(out, "k1", "k2", "ends_sha256")
                out = []
        if node:
            out.append((*node, h.hexdigest()))
        if out:
            yield _rows(out, "k1", "k2", "ends_sha256")

    packed = ranged.mapInArrow(pack, "k1 long, k2 long, first long, ids string")
    hashed = packed.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")
    return hashed.select(F.struct("k1", "k2").alias("node"), "ends_sha256")


def _rows(rows: list[tuple], *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string() if n in ("ids", "ends_sha256") else pa.int64()) for n, c in zip(names, zip(*rows))], names=names)


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    ``rows``: conv_id, depth (1, 2, ...), digest, words; ``convs``: every conv_id once, also those without turns."""
    keyed = materialize(prefixes(rows), "prefix-keys")
    root = F.struct(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"))
    none = F.lit(None).cast("struct<k1:bigint,k2:bigint>")
    below = keyed.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("depth").alias("depth"),
                                      F.min("parent").alias("parent"), F.min("words").alias("words"))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        root.alias("node"), "conv_id", "n_convs", F.lit(0).cast("long").alias("depth"), none.alias("parent"), F.lit(0).cast("long").alias("words"))
    nodes = materialize(below.select(*top.columns).union(top), "trie-nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(children, "node", "left").na.fill(0, ["n_children"]), "trie")
    lowest_bit = F.bit_count(F.expr("(depth & -depth) - 1"))
    totals = subtree_totals(nodes.select(
        "node", "parent", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), ["n_leaves", "saved_tokens"], lowest_bit)
    last = keyed.groupBy("conv_id").agg(F.max(F.struct("depth", "node")).alias("last")).select("conv_id", "last.node")
    ends = materialize(convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("node", root).alias("node")), "trie-ends")
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(totals, "node").join(ends_digest(ends), "node", "left")
    return found.join(above, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
