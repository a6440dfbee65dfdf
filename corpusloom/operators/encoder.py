"""Op 75, the default encoder: character-trigram counts, made where the texts lie."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .plugins import trigram_counts


def trigram_embeddings(texts: DataFrame, dim: int = 64, text_col: str = "text") -> DataFrame:
    """(text, vec) of the distinct texts: counts of character trigrams (two spaces added at either end) by
    md5 slot, L2-normalised. Only the distinct texts are shuffled; a task hashes each distinct trigram of an
    Arrow batch's texts once and counts with numpy."""
    ship_package(texts.sparkSession)
    distinct = texts.select(F.col(text_col).alias(text_col)).where(F.col(text_col).isNotNull()).distinct()

    def slot(gram: str) -> int:
        return int(hashlib.md5(gram.encode("utf-8")).hexdigest()[:8], 16) % dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = trigram_counts(batch.column(0).to_pylist(), dim, slot)
            vec = n / np.sqrt((n * n).sum(axis=1, keepdims=True))
            places = np.arange(0, n.size + 1, dim, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(places, vec.reshape(-1))], names=[text_col, "vec"])

    return distinct.mapInArrow(run, f"`{text_col}` string, vec array<double>")


def encoder(dim: int = 64):
    """The default encoder in the form that ``evalstats.best_variant`` takes."""
    return lambda texts: trigram_embeddings(texts, dim)
