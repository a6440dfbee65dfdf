"""Side-by-side check of a Spark result against DuckDB SQL over the same parquet tables.

Used by the tests (small fixtures) and by developers; mirrors what the external driver records:
row count, column names, and an order-insensitive comparison of values.
"""

from __future__ import annotations

import math

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duckdb_frame(sql: str, sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir.rstrip('/')}/{t}.parquet')")
    return con.sql(sql).df()


def _norm(v):
    if v is None or type(v).__name__ == "NAType":
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=repr)


def compare(spark_df, sql: str, sf_dir: str) -> dict:
    left = spark_df.toPandas()
    right = duckdb_frame(sql, sf_dir)
    lc, lr = rows_of(left)
    rc, rr = rows_of(right)
    result = {"rows_spark": len(lr), "rows_oracle": len(rr), "columns_match": lc == rc,
              "values_match": lc == rc and lr == rr}
    if not result["values_match"]:
        result["columns"] = (lc, rc)
        diff_l = [r for r in lr if r not in set(rr)][:3]
        diff_r = [r for r in rr if r not in set(lr)][:3]
        result["only_spark"] = diff_l
        result["only_oracle"] = diff_r
    return result
