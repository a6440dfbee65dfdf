"""Model results kept between runs, and metrics observed while a table is written."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.operators import evalstats as E
from corpusloom.operators import gates as G
from corpusloom.operators import plugins as PL
from corpusloom.operators import profile as PR
from corpusloom.operators.model_cache import ModelCache
from corpusloom.plans.curation import Curation

SF_SMALL = "/root/testdata/sf0.001"
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def broken():
    raise RuntimeError("the model was called")


def texts(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "text string")


def lengths(df):
    return df.select("text", F.length("text").alias("n"))


def test_a_second_run_calls_no_model(spark, scratch):
    embed = lambda factory: lambda t: PL.embed_texts(t, factory, 8)
    cache = ModelCache(spark, scratch, "enc/1")
    first = cache.results(texts(spark, "a", "b", "b", None, ""), embed(PL.default_encoder_factory(8)))
    assert first.count() == 3
    again = ModelCache(spark, scratch, "enc/1").results(texts(spark, "b", "", "b"), embed(broken))
    assert sorted(map(str, again.collect())) == sorted(str(r) for r in first.collect() if r.digest in {x.digest for x in again.collect()})
    assert again.count() == 2
    with pytest.raises(Exception, match="the model was called"):
        ModelCache(spark, scratch, "enc/1").results(texts(spark, "b", "new"), embed(broken))
    with pytest.raises(Exception, match="the model was called"):  # another version knows nothing
        ModelCache(spark, scratch, "enc/2").results(texts(spark, "b"), embed(broken))
    assert cache.rows(first.schema).count() == 3  # failed runs left nothing
    assert cache.results(texts(spark, "b", "new"), embed(PL.default_encoder_factory(8))).count() == 2


def test_only_new_texts_are_computed(spark, scratch):
    cache = ModelCache(spark, scratch, "len")
    seen = []

    def model(df):
        seen.append(df)
        return lengths(df)
    cache.results(texts(spark, "a", "bb"), model)
    cache.results(texts(spark, "bb", "ccc"), model)
    assert sorted(r.n for r in spark.read.parquet(cache.folder).collect()) == [1, 2, 3]


SAMPLES = [("le chat", "the cat", "fr"), ("the dog", None, "en"), (None, "le chien", "en"), ("", "vide", "fr"),
           ("the dog", "le chien", "en"), ("the dog", "le chien", "en"), ("sans langue", "x", None)]


@pytest.mark.parametrize("cached", [False, True])
def test_comparison_keeps_every_row(spark, scratch, cached):
    samples = spark.createDataFrame(SAMPLES, "source string, target string, source_lang string")
    names = {"reversed": PL.reversing_translator, "marked": PL.marking_translator}
    run = lambda factories, encoder: E.compare_translations(samples, factories, encoder, 16, cache=scratch if cached else None)
    rows = run(names, PL.default_encoder_factory(16)).collect()
    assert len(rows) == 2 * len(SAMPLES)
    by = {(r.translator_name, r.source, r.target): r for r in rows}
    assert by["reversed", "le chat", "the cat"].translated_text == "chat le"
    assert by["marked", "the dog", "le chien"].translated_text == "en>fr the dog"
    assert by["reversed", "", "vide"].translated_text is None and by["reversed", "", "vide"].cosine_similarity_vs_source is None
    missing = by["marked", "the dog", None]
    assert missing.cosine_similarity_vs_source is not None and missing.cosine_similarity_vs_target is None
    assert by["marked", None, "le chien"].translated_text is None and by["marked", "sans langue", "x"].translated_text is None
    if cached:
        again = run({n: broken for n in names}, broken).collect()
        assert sorted(map(str, again)) == sorted(map(str, rows))


def jobs(spark, group, run):
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return out, len(sc.statusTracker().getJobIdsForGroup(group))


def test_the_guard_costs_no_job(spark):
    df = spark.range(100).where("id % 2 = 0").select("id", F.lit("x").alias("v"))
    _, plain = jobs(spark, "plain-write", lambda: session.materialize(df, "plain"))
    (written, seen), guarded = jobs(spark, "guarded-write", lambda: G.write_required(df, "filtering", {"total": F.sum("id")}))
    assert guarded == plain and seen == {"n_rows": 50, "total": 2450} and written.count() == 50
    for none in (df.where("id > 1000"), df.limit(0), spark.createDataFrame([], "id long")):
        with pytest.raises(G.EmptyResultError, match="No data remaining after filtering"):
            G.write_required(none, "filtering")


def test_gate_metrics_are_seen_while_the_stage_is_written(spark):
    c = Curation(spark, SF_SMALL)
    c.features_core()
    seen, _ = jobs(spark, "gate", c.gate_metrics)
    again, later = jobs(spark, "gate-again", c.gate_metrics)
    assert later == 0 and again == seen
    sums, kept = PR.exclusion_summary(c.gate_flags()).first().asDict(), PR.kept_fraction(c.gate_flags()).first().asDict()
    assert {k: seen[k] for k in sums} == sums and all(seen[k] == kept[k] for k in ("n_total", "n_kept", "n_above_threshold"))
    c.close()
