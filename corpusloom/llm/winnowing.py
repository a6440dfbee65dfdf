"""Document fingerprints by winnowing.

All rolling ``k``-grams of a text's code points are hashed. In every window of ``w`` consecutive hashes the
smallest is chosen, the rightmost one if it occurs more than once; the fingerprint is the set of chosen
hashes with their positions. Two texts that share a passage of at least ``k + w - 1`` code points share a
chosen hash at that passage, and no passage shorter than ``k`` is ever matched.

A text of fewer than ``k`` code points is one gram, an empty one has an empty fingerprint; with fewer
than ``w`` grams the only window is all of them. Likeness is the Jaccard index of the hash sets (1 for
two empty ones).

``compare_edits`` needs each document next to its follower in descending id order. Rows are
range-partitioned by id, so a text moves once; a task streams through its sorted rows holding two texts,
and hands the first and last row of its partition to a second, small step that closes the gaps.

Edge cases: a null text is empty; null ids come last, and rows with equal ids are ordered by their text's
digest, repeated rows beside each other; a single document follows itself; an empty table gives no rows. A very long
text is hashed whole, with about 60 bytes a character. Other columns of the input are not read by ``compare_edits``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField

from ..session import materialize
from .arrow import BASE, BASE_INVERSE, append_columns, bound_batches, mix, powers

K, W = 16, 33
_LOW = np.uint64(0xFFFFFFFF)


def winnow(text: str | None, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes (uint64) and their positions (in code points), in order of position."""
    c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(c):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = min(k, len(c))
    sums = np.zeros(len(c) + 1, np.uint64)
    np.cumsum((c + np.uint64(1)) * powers(BASE, len(c)), out=sums[1:])
    n = len(c) - k + 1
    hashes = mix((sums[k:] - sums[:n]) * powers(BASE_INVERSE, n))
    # the smallest hash wins; among equal ones the largest position has the smallest lower half
    least = (hashes & ~_LOW) | (_LOW - np.arange(n, dtype=np.uint64))
    w, reach = min(w, n), 1
    while 2 * reach <= w:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < w:
        least = np.minimum(least[: n - w + 1], least[w - reach:])
    chosen = (_LOW - (least & _LOW)).astype(np.int64)
    chosen = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])]
    return hashes[chosen], chosen


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def digest(hashes: np.ndarray, positions: np.ndarray) -> str:
    """A 128-bit name of a fingerprint, positions included, in hex."""
    return hashlib.blake2b(hashes.tobytes() + positions.tobytes(), digest_size=16).hexdigest()


def fingerprints(df: DataFrame, text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """``df`` with ``hashes`` (as signed 64-bit integers) and ``positions``, arrays of equal length. No shuffle."""
    def run(texts):
        found = [winnow(t, k, w) for t in texts]
        return {"hashes": [h.view(np.int64) for h, _ in found], "positions": [p for _, p in found]}
    return append_columns(df, text_col, [StructField("hashes", ArrayType(LongType())), StructField("positions", ArrayType(LongType()))], run)


def edit(text: str, follower: str) -> str:
    """The text with its last half of code points replaced by the follower's first as many (or all)."""
    half = len(text) // 2
    return text[: len(text) - half] + follower[:half]


_RESULT = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")
_ROW = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                  ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _judge(doc_id, text: str, own: tuple, follower: str, other: tuple, k: int, w: int) -> tuple:
    edited = edit(text, follower)
    changed = own if edited == text else winnow(edited, k, w)
    return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest(*own), digest(*changed),
            likeness(own[0], changed[0]), likeness(own[0], other[0]))


def compare_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """One row per row of ``df``: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = df.sparkSession
    bound_batches(spark)
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = None, None

        def emit(rows, edge=None):
            own = pa.RecordBatch.from_pylist([dict(zip(_ROW.names, r)) for r in rows], schema=_ROW)
            side, number, ids, texts = edge or (None, None, None, None)
            n = len(rows)
            extra = [pa.array([x] * n, t) for x, t in ((side, pa.string()), (number, pa.int64()), (texts, pa.string()))]
            return pa.RecordBatch.from_arrays([*own.columns, *extra], names=[*_ROW.names, "side", "part", "text"])

        empty = (None,) * (len(_ROW.names) - 1)
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for i, scalar in enumerate(batch.column(1)):
                text = scalar.as_py()
                own = winnow(text, k, w)
                if held is None:
                    part = batch.column(2)[0].as_py()
                    yield emit([(ids[i], *empty)], ("first", part, ids[i], text))
                else:
                    out.append(_judge(*held, text, own, k, w))
                held = (ids[i], text, own)
            yield emit(out)
        if held is not None:
            yield emit([(held[0], *empty)], ("last", part, held[0], held[1]))

    found = materialize(rows.mapInArrow(stream, f"{_RESULT}, side string, part long, text string"), "winnow")
    parts = sorted(r["part"] for r in found.where("side = 'first'").select("part").collect())  # one number per partition
    if not parts:
        return found.select(*_ROW.names).limit(0)
    after = spark.createDataFrame(list(zip(parts, [*parts[1:], parts[0]])), "part long, next long")
    firsts = found.where("side = 'first'").select(F.col("part").alias("next"), F.col("text").alias("follower"))
    lasts = found.where("side = 'last'").select("id", "text", "part").join(F.broadcast(after), "part")  # a row per partition

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_judge(i, t, winnow(t, k, w), f, winnow(f, k, w), k, w)
                   for i, t, f in zip(*(batch.column(c).to_pylist() for c in range(3)))]
            yield pa.RecordBatch.from_pylist([dict(zip(_ROW.names, r)) for r in out], schema=_ROW)

    closed = lasts.join(firsts, "next").select("id", "text", "follower").mapInArrow(close, _RESULT)
    return found.where("side is null").select(*_ROW.names).union(closed)
