"""Every registered query against its DuckDB oracle on the smallest tables (the driver does the same
at sf0.01). Queries without SQL are checked to run and return rows."""

import importlib.util
import os

import pytest

from corpusloom.plans import catalog
from corpusloom.plans.compare import compare

SF_SMALL = "/root/testdata/sf0.001"

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
ENTRY = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(ENTRY)
QUERIES = {k: v for k, v in ENTRY.queries().items() if k in catalog.QUERIES}
ORACLE = {k: v for k, v in ENTRY.oracle_sql().items() if k in catalog.ORACLE}


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) == 92 and set(QUERIES) - set(ORACLE) == {
        "tagger_counts", "tagger_gate", "subword_vocabulary", "subword_tokens", "compare_models"}


def test_entry_smoke(spark):
    df = ENTRY.entry(spark)
    assert df.count() > 0
    assert df.columns == ["pair_id", "direction", "source", "target", "source_lang"]


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, key):
    df = QUERIES[key](spark, SF_SMALL)
    if key in ORACLE:
        r = compare(df, ORACLE[key], SF_SMALL)
        assert r["values_match"], r
    else:
        assert df.count() > 0
