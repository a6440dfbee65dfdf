"""Rules that the oracle shares with the engine, held against independent implementations, and rows that the
fixture does not have: repeated and missing keys, empty and missing texts, blanks, NaN."""

import csv
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import accent as A
from corpusloom.operators import evalstats as E
from corpusloom.operators import gates as G
from corpusloom.operators import prep as P
from corpusloom.operators import profile as PR
from corpusloom.operators import sampling as S
from corpusloom.operators.ordinal import with_running_total
from corpusloom.operators.sizing import broadcast_if_small
from corpusloom.plans.curation import PairKeyError, curate
from corpusloom.sources import corpus as IO
from corpusloom.streaming.rowlocal import row_local_flags


@pytest.mark.parametrize("values", [[0.7 + i % 31 / 100 for i in range(500)], [0.5] * 4, [1.0, 2.0], list(np.random.default_rng(1).random(300))])
def test_histogram_equals_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "similarity double")
    counts, edges = np.histogram(values, bins=30)
    got = sorted(PR.similarity_histogram(df).collect())
    assert [r["count"] for r in got] == counts.tolist()
    assert np.allclose([r.lower for r in got], edges[:-1], atol=1e-6) and np.allclose([r.upper for r in got], edges[1:], atol=1e-6)


def test_csv_keeps_blanks_empty_texts_and_line_breaks(spark, scratch):
    texts = ["  lead and trail  ", "", None, 'a "quote", and\na line', "\t"]
    rows = [(t, "x", "en", "fr", "m", t, 0.5, None, 1.0) for t in texts]
    df = spark.createDataFrame(rows, IO.COMPARISON_SCHEMA)
    path = IO.write_comparison(df.coalesce(1), scratch, "r1")
    assert sorted(map(str, IO.read_scores(spark, path, IO.COMPARISON_SCHEMA).collect())) == sorted(map(str, df.collect()))
    raw = "".join(r.value + "\n" for r in spark.read.text(path).collect())
    assert [r[0] for r in csv.reader(io.StringIO(raw))][1] == texts[0]


def test_sinks_leave_out_records_with_a_missing_side(spark, scratch):
    pairs = spark.createDataFrame([(1, None, "a"), (2, "b", None), (3, "c", "d")], "pair_id long, fr string, en string")
    path = IO.write_corpus(P.bidirectional(pairs), f"{scratch}/c")
    assert spark.read.text(path).count() == 2
    path = IO.write_prompt_corpus(pairs, f"{scratch}/p")
    assert spark.read.text(path).count() == 2


def test_accent_repair_with_repeated_and_missing_keys(spark):
    ranked = spark.createDataFrame([("ble", "blé", True), ("ete", "été", True)], "anglicised string, accented string, in_map boolean")
    rows = [(1, "ble un"), (2, "ble un"), (2, "le zut deux ble"), (2, "le zut deux ble"), (2, "ete ble"), (None, "ble nul"), (None, "rien"), (3, None)]
    df = spark.createDataFrame(rows, "pair_id long, fr string")
    got = A.replace_accents(df, ranked, 10, "fr", "out").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.out == (None if r.fr is None else r.fr.replace("ble", "blé").replace("ete", "été"))
    hits = A.word_list_hits(df, spark.createDataFrame([("ble",), ("deux",)], "word string"), "fr", "n").collect()
    assert len(hits) == len(rows)
    for r in hits:
        assert r.n == sum(w in ("ble", "deux") for w in (r.fr or "").split())


def test_curation_refuses_keys_that_are_not_unique(spark):
    words = spark.createDataFrame([("le",)], "word string")
    for rows in ([(1, "a", "b", 0.9), (1, "c", "d", 0.8)], [(None, "a", "b", 0.9)]):
        with pytest.raises(PairKeyError):
            curate(spark, spark.createDataFrame(rows, "pair_id long, fr string, en string, similarity double"), words).pairs()


def test_lexicon_with_a_repeated_word_adds_no_rows(spark):
    mapping = spark.createDataFrame([("ble", "blé", 3, 1, 1)], "anglicised string, accented string, count long, n_forms long, form_rank int")
    assert A.lexicon_split(mapping, spark.createDataFrame([("ble",), ("ble",)], "word string")).count() == 1


def test_nan_similarity_is_missing_on_a_stream_as_in_batch(spark):
    df = spark.createDataFrame([(1, "a b", "a b", float("nan")), (2, "a b", "a b", None)], "pair_id long, fr string, en string, similarity double")
    a, b = (tuple(r)[1:] for r in row_local_flags(df).orderBy("pair_id").collect())
    assert a == b


def test_every_model_needs_rows_of_both_splits(spark):
    records = spark.createDataFrame([(i, "a", "b", "en", "eval" if i % 5 == 0 else "train") for i in range(20)],
                                    "record_id long, source string, target string, source_lang string, split string")
    sizes = P.train_sizes(records, P.registry(spark))
    assert {r.model: r.train_rows for r in sizes.collect()}["mbart50_mmt_en"] == 0
    with pytest.raises(G.EmptyResultError, match="mbart50_mmt_en .*opus_mt_fr_en"):
        G.require_rows_per_model(sizes, "filtering")


def test_cap_counts_each_model_after_its_own_filter(spark):
    records = spark.createDataFrame([(i, "en" if i % 2 else "fr", "train") for i in range(400)], "record_id long, source_lang string, split string")
    got = S.cap_rows_per_model(records, "record_id", {"train": 150, "eval": 10})
    n = {r.model: r["count"] for r in got.groupBy("model").count().collect()}
    assert set(n.values()) == {150} and len(n) == 5
    only = got.join(records, "record_id").where("model = 'opus_mt_fr_en'").select("source_lang").distinct().collect()
    assert [r.source_lang for r in only] == ["fr"]


def test_two_snapshots_and_every_row(spark):
    before = spark.createDataFrame([(1, "a", "x", 0.5), (2, "b", "y", 0.5), (3, None, "z", 0.5)], "pair_id long, fr string, en string, similarity double")
    after = spark.createDataFrame([(1, "a", "x", 0.6), (3, "c", "z", 0.4)], "pair_id long, fr string, en string, similarity double")
    assert [tuple(r) for r in E.changed_between(before, after).collect()] == [(3, None, "c")]
    assert [r.pair_id for r in E.improved_rows(before, after).collect()] == [1]
    every = {r.pair_id: r.similarity_updated for r in E.improved_rows(before, after, show_all=True).collect()}
    assert every == {1: 0.6, 2: None, 3: 0.4}


def test_samples_can_come_from_one_split(spark):
    df = spark.createDataFrame([(i, "eval" if i % 4 == 0 else "train") for i in range(100)], "record_id long, split string")
    assert {r.split for r in S.sample_rows(df, 10, "record_id", split="eval").collect()} == {"eval"}


def test_running_total_with_a_hot_group(spark):
    rows = [("a" if i % 3 else "b", i, i % 7) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(6)
    sums, want = {}, {}
    for g, k, v in rows:
        want[k] = sums.get(g, 0)
        sums[g] = want[k] + v
    assert {r.k: r.t for r in with_running_total(df, ["k"], "v", "t", ["g"]).collect()} == want


def test_broadcasts_are_bounded_in_rows_and_bytes(spark):
    small, wide = spark.range(10), spark.range(10).select(F.repeat(F.lit("x"), 300_000).alias("t"))
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(broadcast_if_small(small, 100)) and not hinted(broadcast_if_small(small, 5))
    assert not hinted(broadcast_if_small(wide, 100, max_mb=2)) and hinted(broadcast_if_small(wide, 100))


def test_survey_categories_long_and_wide(spark):
    df = spark.createDataFrame([("s", "t", "good", None), ("s", "t", "good", "odd")], "source string, corpus_type string, m1 string, m2 string")
    assert {tuple(r) for r in E.category_counts(df).collect()} == {("m1", "good", 2), ("m2", None, 1), ("m2", "odd", 1)}
    wide = {r.column_name: (r.best, r.good, r.NaN) for r in E.categorical_counts(df, ["good", "best"]).collect()}
    assert wide == {"m1": (0, 2, 0), "m2": (0, 0, 1)}


def test_a_source_of_unknown_size_gets_the_sessions_partitions(spark):
    from corpusloom.session import bucket_count
    df = spark.createDataFrame([(1, "a")], "pair_id long, fr string")
    assert bucket_count(df) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert bucket_count(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), target_mb=1) < 100
