"""Property tests: distributed ordinals and percentiles against brute force, split stability,
train/test disjointness, sink line counts, idempotent repair, stream = batch."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import gates as G
from corpusloom.operators import prep as P
from corpusloom.operators import sampling as S
from corpusloom.operators.ordinal import with_ordinal
from corpusloom.operators.quantiles import exact_percentiles
from corpusloom.plans.curation import curation
from corpusloom.sources import corpus as IO
from corpusloom.streaming import rowlocal as RL

SF_SMALL = "/root/testdata/sf0.001"


def test_ordinal_equals_row_number_with_hot_key(spark):
    rng = random.Random(7)
    # one value holds a third of the rows
    rows = [(g, 5 if i % 3 == 0 else rng.randint(0, 50), i) for i, g in
            enumerate(rng.choice(["a", "b", "c"]) for _ in range(3000))]
    df = spark.createDataFrame(rows, "g string, v int, id long").repartition(7)
    got = with_ordinal(df, order=["v", "id"], groups=["g"], out_col="o", num_partitions=5)
    w = Window.partitionBy("g").orderBy("v", "id")
    want = df.withColumn("o", F.row_number().over(w) - 1)
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())


def test_exact_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(size=900), np.full(450, 0.25)])
    rows = [("k", float(v)) for v in vals] + [("k", None), ("k", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.00135, 0.01, 0.5, 0.9, 0.99865]
    names = [f"p{i}" for i in range(len(probs))]
    want = [round(float(x), 6) for x in np.percentile(vals, [p * 100 for p in probs])]
    for method in ("auto", "aggregate", "sketch"):
        got = exact_percentiles(df, ["g"], "v", probs, names, method=method).first()
        assert [got[n] for n in names] == want, method


def test_exact_percentiles_golden(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 10]], "v double")
    for method in ("aggregate", "sketch"):
        got = exact_percentiles(df, [], "v", [0.01, 0.1, 0.5, 0.9, 0.99], ["a", "b", "c", "d", "e"],
                                method=method).first()
        assert [got[k] for k in "abcde"] == [1.04, 1.4, 3.0, 7.6, 9.76], method


def test_split_is_stable_under_repartitioning(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "record_id")
    a = S.train_eval_split(df, "record_id").where("split = 'eval'").select("record_id")
    b = S.train_eval_split(df.repartition(13), "record_id").where("split = 'eval'").select("record_id")
    ids_a = sorted(r[0] for r in a.collect())
    assert ids_a == sorted(r[0] for r in b.collect())
    assert 150 < len(ids_a) < 350  # about 5 %


def test_shuffle_positions_are_dense(spark):
    df = S.train_eval_split(spark.range(0, 2000).withColumnRenamed("id", "record_id"), "record_id")
    shuffled = S.seeded_shuffle(df, "record_id")
    stats = shuffled.groupBy("split").agg(F.min("position").alias("lo"), F.max("position").alias("hi"),
                                          F.count(F.lit(1)).alias("n"), F.countDistinct("position").alias("d"))
    for r in stats.collect():
        assert r["lo"] == 0 and r["hi"] == r["n"] - 1 and r["d"] == r["n"]


def test_training_and_test_sets_are_disjoint(spark):
    g = curation(spark, SF_SMALL).gated()
    train = set(r[0] for r in G.training_pairs(g).select("pair_id").collect())
    test = set(r[0] for r in G.relaxed_test_pairs(g).select("pair_id").collect())
    assert train and test and not (train & test)


def test_written_lines_are_twice_the_kept_pairs(spark, scratch):
    g = curation(spark, SF_SMALL).gated()
    kept = G.training_pairs(g)
    path = IO.write_corpus(P.bidirectional(kept), os.path.join(scratch, "train"))
    stats = IO.sink_stats(spark, path).first()
    assert stats["line_count"] == 2 * kept.count()
    assert stats["size_kb"] > 0


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet=list("lLdDsStT a'x"), max_size=20))
def test_apostrophe_repair_is_idempotent(spark, s):
    df = spark.createDataFrame([(s,)], "x string")
    once = df.select(T.repair_apostrophes(F.col("x")).alias("x"))
    twice = once.select(T.repair_apostrophes(F.col("x")).alias("x"))
    assert once.first()["x"] == twice.first()["x"]


def test_stream_equals_batch(spark, scratch):
    pairs = curation(spark, SF_SMALL).pairs()
    src = os.path.join(scratch, "src")
    pairs.repartition(4).write.parquet(src)
    q = RL.flag_pair_stream(spark, src, os.path.join(scratch, "sink"), os.path.join(scratch, "ckpt"))
    q.awaitTermination(300)
    streamed = spark.read.parquet(os.path.join(scratch, "sink"))
    batch = RL.row_local_flags(spark.read.schema(IO.PAIR_SCHEMA).parquet(src))
    cols = sorted(batch.columns)
    assert sorted(streamed.select(*cols).collect(), key=str) == sorted(batch.select(*cols).collect(), key=str)


def test_require_rows_raises(spark):
    empty = spark.range(0).withColumnRenamed("id", "x")
    try:
        G.require_rows(empty, "filtering")
    except G.EmptyResultError as e:
        assert "filtering" in str(e)
    else:
        raise AssertionError("expected EmptyResultError")


def test_exact_percentiles_with_coarse_sketch_and_forced_fallback(spark, monkeypatch):
    from corpusloom.operators import quantiles as Q
    rng = np.random.default_rng(11)
    vals = np.concatenate([rng.exponential(size=700), np.full(300, 2.0)])
    df = spark.createDataFrame([("g", float(v)) for v in vals], "g string, v double")
    probs = [0.001, 0.25, 0.5, 0.9, 0.999]
    names = [f"q{i}" for i in range(len(probs))]
    want = [round(float(x), 6) for x in np.percentile(vals, [p * 100 for p in probs])]
    coarse = Q.exact_percentiles(df, ["g"], "v", probs, names, accuracy=20, method="sketch").first()
    assert [coarse[n] for n in names] == want
    real_targets = Q._targets

    def shifted(*args, **kwargs):  # brackets that miss the wanted ranks
        t = real_targets(*args, **kwargs)
        return t.withColumn("_blo", F.col("_bhi") + 1.0).withColumn("_bhi", F.col("_blo") + 1.0)

    monkeypatch.setattr(Q, "_targets", shifted)
    fallback = Q.exact_percentiles(df, ["g"], "v", probs, names, method="sketch").first()
    assert [fallback[n] for n in names] == want


def test_curation_on_a_callers_own_pairs(spark):
    from corpusloom.plans.curation import curate
    rows = [(1, "La mer est calme et belle", "The sea is calm and beautiful", 0.95),
            (2, "Le ble a ete recolte tot", "The wheat was harvested early", 0.95),
            (3, "L ete a ete chaud", "The summer was hot", 0.95),
            (4, "Le blé a été récolté en été", "Wheat was harvested in summer", 0.95),
            (5, "Voir Tableau 3", "See Table 3", 0.95),
            (6, "Une phrase", "A sentence", float("nan"))]
    pairs = spark.createDataFrame(rows, "pair_id long, fr string, en string, similarity double")
    lexicon = spark.createDataFrame([("mer",), ("calme",)], "word string")
    c = curate(spark, pairs, lexicon, cutoff=10)
    g = {r["pair_id"]: r for r in c.gated().collect()}
    assert g[2]["fr"] == "Le blé a été récolté tot"          # accents learned from row 4
    assert g[3]["fr"] == "L'été a été chaud"                  # apostrophe, then accents
    assert g[5]["exclude_figtext"] and g[5]["exclude"]
    assert g[6]["similarity"] is None and not g[6]["exclude_low_similarity"]
    assert not g[1]["exclude"]


def test_require_model():
    assert G.require_model("opus_mt_en_fr")["restrict_source_language"] == "en"
    try:
        G.require_model("nope")
    except G.UnknownModelError as e:
        assert "m2m100_418m" in str(e)
    else:
        raise AssertionError("expected UnknownModelError")


def test_split_by_pair_keeps_both_directions_together(spark):
    recs = P.bidirectional(curation(spark, SF_SMALL).pairs())
    by_pair = S.train_eval_split(recs, "pair_id")
    mixed = by_pair.groupBy("pair_id").agg(F.countDistinct("split").alias("k")).where("k > 1")
    assert mixed.count() == 0


def test_read_pairs_casts_numeric_widths_and_rejects_text(spark, scratch):
    path = os.path.join(scratch, "p")
    spark.createDataFrame([(1, "a", "b", 0.5)], "pair_id int, fr string, en string, similarity float") \
         .write.parquet(path)
    df = IO.read_pairs(spark, path)
    assert dict(df.dtypes) == {"pair_id": "bigint", "fr": "string", "en": "string", "similarity": "double"}
    bad = os.path.join(scratch, "q")
    spark.createDataFrame([(1, 2, "b", 0.5)], "pair_id long, fr int, en string, similarity double").write.parquet(bad)
    try:
        IO.read_pairs(spark, bad)
    except ValueError as e:
        assert "fr" in str(e)
    else:
        raise AssertionError("expected a schema error")


def test_identity_accent_entries(spark):
    from corpusloom.plans.curation import curate
    rows = [(1, "un cœur et un été", "a heart and a summer", 0.95), (2, "le cœur", "the heart", 0.95)]
    pairs = spark.createDataFrame(rows, "pair_id long, fr string, en string, similarity double")
    lexicon = spark.createDataFrame([("zz",)], "word string")
    kept = {r["accented"] for r in curate(spark, pairs, lexicon, cutoff=1).vocabulary().collect()}
    skipped = {r["accented"] for r in curate(spark, pairs, lexicon, cutoff=1, skip_identity=True).vocabulary().collect()}
    assert "cœur" in kept and "cœur" not in skipped and "été" in skipped
    # as in the original: with the identity entry ranked first, "été" falls below the cut-off
    g = {r["pair_id"]: r["potential_fr_accent_issues"] for r in curate(spark, pairs, lexicon, cutoff=1).features().collect()}
    assert g == {1: 0, 2: 0}


@pytest.mark.parametrize("aqe", ["true", "false"])
@pytest.mark.parametrize("parts", [None, 3])
def test_ordinal_independent_of_adaptive_execution(spark, aqe, parts):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    try:
        df = spark.range(0, 2000).select((F.col("id") % 7).alias("v"), F.col("id")).repartition(5)
        got = with_ordinal(df, order=["v", "id"], out_col="o", num_partitions=parts)
        rows = sorted((r["v"], r["id"], r["o"]) for r in got.collect())
        want = sorted(zip([v for v, _ in sorted((i % 7, i) for i in range(2000))],
                          [i for _, i in sorted((i % 7, i) for i in range(2000))], range(2000)))
        assert rows == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
