"""Broadcast decisions behind a check of rows and bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_MB = 256


def is_small(df: DataFrame, max_rows: int, max_mb: int = MAX_BROADCAST_MB) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and ``max_mb`` megabytes (string bytes, 16 a value otherwise)."""
    row_bytes = F.lit(0)
    for name, kind in df.dtypes:
        row_bytes = row_bytes + (F.coalesce(F.octet_length(F.col(name)), F.lit(0)) + F.lit(16) if kind == "string" else F.lit(16))
    n, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes), F.lit(0))).first()
    return n <= max_rows and size <= max_mb << 20


def broadcast_if_small(df: DataFrame, max_rows: int, max_mb: int = MAX_BROADCAST_MB) -> DataFrame:
    """Broadcast ``df`` when ``is_small``; else leave the join to a shuffle (with AQE's skew-join handling). Meant for
    tables that are already materialised (written stages, aggregated vocabularies), where the check is cheap."""
    return F.broadcast(df) if is_small(df, max_rows, max_mb) else df
