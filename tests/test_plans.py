"""Scale properties of every registered query's physical plan: no cartesian products or
nested-loop joins, no row-at-a-time Python, and no window without a partition key (which would
pull a whole table into one task)."""

import importlib.util
import os
import re

import pytest

from corpusloom import session
from corpusloom.plans import catalog

SF_SMALL = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_spec = importlib.util.spec_from_file_location("spark_entry_plans", os.path.join(ROOT, "__spark_entry__.py"))
ENTRY = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(ENTRY)
QUERIES = {k: v for k, v in ENTRY.queries().items() if k in catalog.QUERIES}

# their input has one row per range partition (and group): a running sum over it may be one window
PARTITION_TABLES = {"ordinal-offsets", "running-offsets"}
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "MapInPandas", "ArrowEvalPython"]


# the plug-ins' path: a model's batches go through pandas
MODEL_QUERIES = {"compare_models", "subword_tokens"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _faults(plan: str, name: str = "") -> list[str]:
    found = [op for op in FORBIDDEN if op in plan]
    if name in PARTITION_TABLES:
        return found
    for spec in re.findall(r"windowspecdefinition\(([^,)]*)", plan):
        if re.search(r"\b(ASC|DESC)\b", spec) or "specifiedwindowframe" in spec:
            found.append(f"window without partition key: {spec}")
    return found


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_plan_has_no_unscalable_operators(spark, key):
    """The query's own plan, and the plans of all stages that building it has written."""
    since = len(session.WRITTEN_PLANS)
    plan = _plan(QUERIES[key](spark, SF_SMALL))
    allowed = {"MapInPandas"} if key in MODEL_QUERIES else set()
    assert not set(_faults(plan)) - allowed, key
    for name, written in session.WRITTEN_PLANS[since:]:
        assert not set(_faults(written, name)) - allowed, (key, name)


def test_every_stage_is_examined(spark, monkeypatch):
    """A fresh chain writes all stages; a cross join in one of them is a fault."""
    from corpusloom.plans.curation import Curation
    c, since = Curation(spark, SF_SMALL), len(session.WRITTEN_PLANS)
    c.gate_flags()
    written = dict(session.WRITTEN_PLANS[since:])  # name to plan
    assert {"stage-pairs", "stage-features_pre", "stage-vocabulary", "stage-features", "stage-gate_flags"} <= set(written)
    assert not any(_faults(p, n) for n, p in written.items())
    bad, since = Curation(spark, SF_SMALL), len(session.WRITTEN_PLANS)
    monkeypatch.setattr(bad, "pairs", lambda: c.pairs().crossJoin(c.lexicon().limit(2)).drop("word"))
    bad.features_pre()
    assert any(_faults(p, n) for n, p in session.WRITTEN_PLANS[since:])
    c.close()
    bad.close()


def _folders(spark):
    base = os.path.join(session.ensure_checkpoint_dir(spark).removeprefix("file:"), "tables")
    return set(os.listdir(base)) if os.path.isdir(base) else set()


def test_intermediate_tables_are_deleted(spark):
    from corpusloom.plans.curation import Curation
    before, c = _folders(spark), Curation(spark, SF_SMALL)
    c.gate_flags()
    made = _folders(spark) - before
    assert made and all(name.startswith("stage-") for name in made)
    tables = [t for _, t in c._stages.tables if t]
    assert tables and all(spark.catalog.tableExists(t) for t in tables)
    c.close()
    assert not _folders(spark) & made and not any(spark.catalog.tableExists(t) for t in tables)


def test_scopes_leave_other_threads_tables(spark):
    """A table that another thread writes while a stage is built isn't the stage's to delete."""
    import threading
    other, seen = {}, []

    def write():
        other["table"] = session.materialize(spark.range(5), "others")

    with session.Scope(spark) as owned:
        session.materialize(spark.range(1), "mine")
        with session.Scope(spark) as inner:
            session.materialize(spark.range(2), "inner")
            kept = session.materialize(spark.range(3), "kept")
            owned.adopt(inner.release())
        t = threading.Thread(target=write)
        t.start()
        t.join()
        assert kept.count() == 3 and len(owned.tables) == 2
        seen = [path for path, _ in owned.tables]
    assert other["table"].count() == 5
    assert not any(os.path.exists(p.removeprefix("file:")) for p in seen)
    with pytest.raises(ZeroDivisionError), session.Scope(spark) as failed:  # a failing chain leaves nothing
        session.materialize(spark.range(1), "failed")
        path = failed.tables[0][0]
        1 / 0
    assert not os.path.exists(path.removeprefix("file:"))


def test_an_append_can_be_retried(spark, scratch):
    from pyspark.sql import functions as F

    from corpusloom.sources import corpus as IO
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in IO.SWEEP_SCHEMA.fields) + ", model string"
    trials = lambda n: spark.createDataFrame([("t1", 0.1, 8, 16, 0.05, 10, 1, 0.5, 0.4, f"m{i}") for i in range(n)], fields)
    for _ in range(2):
        IO.append_sweep_results(trials(2), scratch, "a")
    IO.append_sweep_results(trials(3), scratch, "b")
    with pytest.raises(Exception):
        IO.append_sweep_results(trials(3).withColumn("lr", F.when(F.col("model") == "m2", F.raise_error(F.lit("x")).cast("double")).otherwise(F.col("lr"))), scratch, "c")
    got = IO.read_sweep_results(spark, scratch).groupBy("run_id").count().collect()
    assert {r.run_id: r["count"] for r in got} == {"a": 2, "b": 3}


def test_a_band_opens_only_its_files(spark, scratch):
    from pyspark.sql import functions as F

    from corpusloom.sources import corpus as IO
    rows = spark.range(5000).select("id", F.when(F.col("id") % 50 != 0, F.col("id") / 5000).alias("s"), F.concat(F.lit("t"), (F.col("id") % 900).cast("string")).alias("x"))
    path = IO.write_clustered(rows, scratch, "s", 10, "x")
    whole = spark.read.parquet(f"{path}/rows")
    band = IO.read_range(spark, path, "s", 0.31, 0.38)
    assert len(whole.inputFiles()) >= 8 and len(band.inputFiles()) <= 2
    assert sorted(r.id for r in band.collect()) == sorted(r.id for r in rows.where("s between 0.31 and 0.38").collect())
    assert IO.read_range(spark, path, "s", 2.0, 3.0).count() == 0
    found = IO.read_text(spark, path, "x", "t7")
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in rows.where("x = 't7'").collect())
    assert "text_digest" in found._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1][:200]
    assert whole.count() == 5000 and IO.read_text(spark, path, "x", "absent").count() == 0
