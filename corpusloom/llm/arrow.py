"""Helpers of the operators that work on whole texts inside Arrow batches.

Spark partitions the rows; a task sees one Arrow batch at a time and cuts it into blocks of a bounded
number of characters, so its memory follows the block (or the longest single text), not the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

BLOCK_CHARS = 300_000
BATCH_ROWS = 1_000
LETTER, DIGIT = 1, 2
#: An odd 64-bit multiplier for polynomial hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows: Spark counts a batch in rows, and the default of 10,000
    whole texts would be held several times over by the JVM and the Python worker. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def append_columns(df: DataFrame, text_col: str, fields: list[StructField],
                   fn: Callable[[list[str | None]], dict[str, Iterable]], max_chars: int = BLOCK_CHARS,
                   close: Callable[[], None] = lambda: None) -> DataFrame:
    """``df`` with the columns that ``fn`` derives from the texts of one block of rows.

    Rows stay where they are: no shuffle, one output row per input row. A column of ``df`` whose name
    equals an output's (in any case) is replaced, as ``withColumn`` does. ``close`` is called when a task's
    rows are through, to let go of what ``fn`` keeps from block to block.
    """
    bound_batches(df.sparkSession)
    made = {f.name.lower() for f in fields}
    if text_col.lower() in made:
        raise ValueError(f"the text column {text_col!r} has the name of an output column")
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in made])
    schema = StructType([*kept.schema.fields, *fields])
    at = [c.lower() for c in kept.columns].index(text_col.lower())
    names, kinds = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for start, texts in text_blocks(batch.column(at), max_chars):
                    part, out = batch.slice(start, len(texts)), fn(texts)
                    yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(out[n], k) for n, k in zip(names, kinds)]],
                                                     names=[*part.schema.names, *names])
        finally:
            close()

    return kept.mapInArrow(run, schema)


def text_blocks(column: pa.Array, max_chars: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of runs of rows with about ``max_chars`` characters; a longer text is alone."""
    start, size, texts = 0, 0, []
    for i, scalar in enumerate(column):
        text = scalar.as_py()
        if texts and size + len(text or "") > max_chars:
            yield start, texts
            start, size, texts = i, 0, []
        texts.append(text)
        size += len(text or "") + 1
    if texts:
        yield start, texts


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points, a line feed before the first and after each, and where each text begins."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = "\n" + "\n".join(texts) + "\n"
    begins = 1 + np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), begins.astype(np.int64)


@lru_cache(maxsize=1)
def character_kinds() -> np.ndarray:
    """For each code point: LETTER, DIGIT or 0."""
    kinds = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            kinds[i] = LETTER
        elif c.isdigit():
            kinds[i] = DIGIT
    return kinds


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends (exclusive) of the runs of True; the first and last elements must be False."""
    turn = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    return turn[0::2], turn[1::2]


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.array([1], np.uint64)
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        if n <= 4 * BLOCK_CHARS:
            _POWERS[base] = have
    return have[:n]


def span_hashes(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``values[begin:end]`` for each span, by prefix sums of a polynomial."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values.astype(np.uint64) * powers(BASE, len(values)))])
    return mix((sums[ends] - sums[begins]) * powers(BASE_INVERSE, len(values) + 1)[begins])


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the entropy of a 64-bit hash over all its bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def hash_share(column: str, share: float | Column) -> Column:
    """True for about ``share`` of the values of ``column``, the same ones in every run."""
    limit = F.floor(F.least(F.lit(1.0), share) * (1 << 30)) if isinstance(share, Column) else int(min(1.0, share) * (1 << 30))
    return F.pmod(F.xxhash64(F.lit("sample"), F.col(column)), F.lit(1 << 30)) < limit
