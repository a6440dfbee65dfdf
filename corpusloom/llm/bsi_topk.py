"""Exact top-k inner products with a bit-sliced index.

Vectors are quantised to integers. Rows are dealt into blocks of about ``BLOCK_ROWS`` by a hash of their
id, and each block is indexed on its own: for every attribute, one bitmap per bit of (value - least) and
one per bit of (greatest - value), a bit per row, rows in order of id.

A query adds up the slices: for digit j of its component and bit i of the attribute, the bitmap counts
2**(i + j) for its rows (the second form serves negative digits, so nothing is ever subtracted). Bitmaps of equal weight are added three at a time by carry-save adders (xor and majority),
from the lowest weight up, until one slice of the score is left for each weight. The top rows are then
selected from the most significant slice downward; rows that tie at the boundary are resolved
exactly, by smaller id, and the chosen rows get their exact integer products.

Every block keeps its k best rows a query; the k best of those, ranked once more, are the answer.

A query set that grows with the table is dealt into slabs. A task takes one block's index and one
slab of queries: both are bounded, whatever the size of the table or of the query set.

Edge cases: vectors that are null or empty or hold null or non-finite components take no part, nor do rows
without an id; only vectors of equal length meet. All rows with a query's id count as its own.
Repeated candidates are all listed, a repeated query is asked once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

BLOCK_ROWS = 16_384
SLAB_QUERIES = 2_048


def quantise(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null if the vector can't take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vector.isNotNull() & (F.size(vector) > 0) & ~bad
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")))


class Index:
    """Bit slices of one block: ``values`` (rows, attributes), rows in order of id."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values, self.rows = ids, values.astype(np.int64), len(ids)
        self.low, self.high = self.values.min(0), self.values.max(0)
        self.words = -(-self.rows // 64)
        slices, place = [], []
        for shifted in (self.values - self.low, self.high - self.values):
            for a in range(values.shape[1]):
                bits = int(self.high[a] - self.low[a]).bit_length()
                place.append(range(len(slices), len(slices) + bits))
                slices += [self._pack((shifted[:, a] >> i) & 1) for i in range(bits)]
        self.slices = np.array(slices, np.uint64).reshape(len(slices), self.words)
        self.bits = max(map(len, place), default=0)
        self.place = np.full((2, values.shape[1], self.bits), -1, np.int64)  # slice of each (form, attribute, bit)
        for n, p in enumerate(place):
            self.place[n // values.shape[1], n % values.shape[1], : len(p)] = p

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        padded = np.zeros(self.words * 64, np.uint8)
        padded[: self.rows] = bits
        return np.packbits(padded, bitorder="little").view(np.uint64)

    def _every(self) -> np.ndarray:
        return self._pack(np.ones(self.rows, np.uint8))

    def score_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of every row's score (less a constant), the lowest first."""
        # non-adjacent form: signed binary digits of which at most half are not 0
        sizes, negative = np.abs(query), query < 0
        mixed = sizes ^ (3 * sizes)
        digits = ((3 * sizes & mixed) >> 1, (sizes & mixed) >> 1)  # counting for and against the component's sign
        by_bit = []
        for j in range(int(mixed.max(initial=0)).bit_length() - 1):
            sides = [np.flatnonzero((d >> j) & 1) for d in digits]
            by_bit.append(np.concatenate([self.place[(negative[a] ^ against).astype(np.int64), a] for against, a in enumerate(sides)]))
        out, carried = [], []
        weight = 0
        while weight < len(by_bit) + self.bits - 1 or carried:
            own = [rows[:, weight - j] for j, rows in enumerate(by_bit) if 0 <= weight - j < self.bits]
            own = np.concatenate(own) if own else np.zeros(0, np.int64)
            left = np.concatenate([self.slices[own[own >= 0]], *carried])
            carried = []
            while len(left) > 2:
                t = len(left) // 3
                a, b, c = left[:t], left[t:2 * t], left[2 * t:3 * t]
                odd = a ^ b
                carried.append((a & b) | (c & odd))
                left = np.concatenate([odd ^ c, left[3 * t:]])
            if len(left) == 2:
                carried.append((left[0] & left[1])[None])
                left = (left[0] ^ left[1])[None]
            out.append(left[0] if len(left) else np.zeros(self.words, np.uint64))
            weight += 1
        return out

    def top(self, query: np.ndarray, own_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the ``k`` best rows but those with ``own_id``."""
        maybe = self._every()
        mine = np.arange(*np.searchsorted(self.ids, [own_id, own_id + 1]))
        for row in mine:
            maybe[row // 64] &= ~np.uint64(1 << int(row % 64))
        sure = np.zeros(self.words, np.uint64)
        for s in reversed(self.score_slices(query)):
            with_bit = sure | (maybe & s)
            n = int(np.bitwise_count(with_bit).sum())
            if n >= k:
                maybe &= s
            else:
                sure, maybe = with_bit, maybe & ~s
            if n == k:
                break
        best = self._rows(sure)
        ties = self._rows(maybe)[: max(0, k - len(best))]  # equal scores: the smaller ids
        rows = np.concatenate([best, ties])
        return self.ids[rows], self.values[rows] @ query

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _pack_rows(key: str):
    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        values = np.stack([np.asarray(v, np.int32) for v in table.column("q").to_pylist()])
        order = np.lexsort((*values.T[::-1], ids))
        return pa.table({"dim": pa.array([values.shape[1]], pa.int32()), key: table.column(key).slice(0, 1).cast(pa.int64()),
                         "ids": pa.array([ids[order].astype(np.int64).tobytes()], pa.binary()),
                         "cells": pa.array([values[order].tobytes()], pa.binary())})
    return pack


def top_k(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), id, score: for each row of ``df`` for which ``is_query`` holds (a condition on the
    column ``id``), the ``k`` rows with the largest integer inner product (all, if fewer), ties to the smaller id."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), quantise(F.col(vector_col), scale).alias("q")) \
             .where("id is not null and q is not null").withColumn("dim", F.size("q"))
    rows = materialize(rows, "bsi-rows")
    asked = rows.where(is_query).distinct()
    counts = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}
    queries = {r["dim"]: r["count"] for r in asked.groupBy("dim").count().collect()}
    least = 2 * spark.sparkContext.defaultParallelism
    blocks = {d: -(-n // BLOCK_ROWS) for d, n in counts.items() if d in queries}
    slabs = {d: max(-(-n // SLAB_QUERIES), min(-(-n // 64), -(-least // blocks[d]))) for d, n in queries.items()}
    per_dim = lambda of: F.create_map(*[F.lit(x) for d in of for x in (d, of[d])]) if of else F.create_map(F.lit(0), F.lit(1))
    n_blocks, n_slabs = per_dim(blocks)[F.col("dim")], per_dim(slabs)[F.col("dim")]
    schema = "dim int, {0} long, ids binary, cells binary"
    number = lambda n: F.pmod(F.xxhash64("id", "q"), n.cast("long"))
    packed = rows.where(n_blocks.isNotNull()).withColumn("block", number(n_blocks)).groupBy("dim", "block") \
                 .applyInArrow(_pack_rows("block"), schema.format("block"))
    index = materialize(packed, "bsi-index")
    slab = materialize(asked.withColumn("slab", number(n_slabs)).groupBy("dim", "slab")
                       .applyInArrow(_pack_rows("slab"), schema.format("slab")), "bsi-slabs")
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))

    def search(block: pa.Table, part: pa.Table) -> pa.Table:
        out = ([], [], [])
        if len(block) and len(part):
            read = lambda t, c, kind: np.frombuffer(t.column(c)[0].as_py(), kind)
            dim = block.column("dim")[0].as_py()
            one = Index(read(block, "ids", np.int64), read(block, "cells", np.int32).reshape(-1, dim))
            asks = read(part, "cells", np.int32).reshape(-1, dim).astype(np.int64)
            for query_id, query in zip(read(part, "ids", np.int64), asks):
                ids, scores = one.top(query, int(query_id), k)
                out[0].append(np.full(len(ids), query_id))
                out[1].append(ids)
                out[2].append(scores)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.table(dict(zip(("query_id", "id", "score"), (pa.array(x, pa.int64()) for x in flat))))

    found = index.withColumn("slab", all_of(n_slabs)).groupBy("block", "slab", "dim").cogroup(
        slab.withColumn("block", all_of(n_blocks)).groupBy("block", "slab", "dim")).applyInArrow(search, "query_id long, id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
