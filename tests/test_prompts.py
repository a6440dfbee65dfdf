"""The pair table from own rows, and what the prompt corpus moves and writes."""

import os
import re

import pytest
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.plans import catalog
from corpusloom.plans import fixtures as X
from corpusloom.plans.curation import Curation

DOCS = [(7, "en", "e7a\n\ne7b"), (3, "en", "e3\n"), (9, "fr", "f9a\nf9b"), (1, "fr", "f1"), (5, "en", "\n".join(f"e5{i}" for i in range(40))),
        (4, "de", "d4"), (6, "en", None), (8, "fr", ""), (None, "en", "lost\nlost"), (None, "fr", "perdu")]
TWICE = [(7, "en", "e7c"), (9, "fr", "f9a\nf9b"), (5, "en", "e5x")]


def _tables(spark, scratch, rows):
    spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3).write.parquet(f"{scratch}/documents.parquet")
    return scratch


def _by_hand(rows):
    """Rows with a doc_id, in its order after those without one; no doc_id twice."""
    numbered = {"en": {}, "fr": {}}
    n = dict.fromkeys(numbered, 0)
    for doc_id, lang, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for line in [x for x in (text or "").split("\n") if x] if lang in n else []:
            if doc_id is not None:
                numbered[lang][n[lang]] = line
            n[lang] += 1
    longer, shorter = ("en", "fr") if n["en"] >= n["fr"] else ("fr", "en")
    return {i: {longer: line, shorter: numbered[shorter][i % n[shorter]]} for i, line in numbered[longer].items() if i % max(1, n[shorter]) in numbered[shorter]}


def _plain(monkeypatch):
    """Pairs as they are before signals are injected."""
    monkeypatch.setattr(X, "inject", lambda pairs: pairs.withColumn("similarity", F.lit(0.9)))


@pytest.mark.parametrize("swap", [False, True])
@pytest.mark.parametrize("most", [1000, 1])
def test_pairs_by_either_key_are_those_by_hand(spark, scratch, monkeypatch, swap, most):
    _plain(monkeypatch)
    monkeypatch.setattr(X, "MAX_COPIES", most)
    rows = [(d, {"en": "fr", "fr": "en"}.get(lang, lang) if swap else lang, t) for d, lang, t in DOCS]
    want = sorted((i, p["fr"], p["en"]) for i, p in _by_hand(rows).items())
    assert len(want) > 20
    for bucketed in (True, False):
        got = X.derive_pairs(spark, _tables(spark, f"{scratch}/{bucketed}", rows), bucketed)
        assert sorted(tuple(r)[:3] for r in got.collect()) == want


@pytest.mark.parametrize("rows", [DOCS + TWICE, DOCS[:1], [r for r in DOCS if r[1] == "de"]])
def test_both_keys_agree_on_repeated_ids_and_missing_languages(spark, scratch, rows):
    path = _tables(spark, scratch, rows)
    rows_of = lambda bucketed: sorted(map(str, X.derive_pairs(spark, path, bucketed).collect()))
    # texts of one doc_id may be numbered either way, and then otherwise the next time
    assert any(rows_of(True) == rows_of(False) for _ in range(3))


def test_pairs_are_not_shuffled_after_their_join(spark, scratch):
    c, since = Curation(spark, _tables(spark, scratch, DOCS)), len(session.WRITTEN_PLANS)
    pairs = c.pairs()
    plan = dict(session.WRITTEN_PLANS[since:])["stage-pairs"]
    first_join = re.search("SortMergeJoin|ShuffledHashJoin|BroadcastHashJoin", plan).start()
    assert "Exchange" not in plan[:first_join] and plan.count("Exchange hashpartitioning(pair_id") == 2
    ids = pairs.select("pair_id", F.input_file_name().alias("f")).groupBy("pair_id").agg(F.count_distinct("f").alias("n"))
    assert ids.where("n > 1").count() == 0
    c.close()


def _folders(spark):
    base = os.path.join(session.ensure_checkpoint_dir(spark).removeprefix("file:"), "tables")
    return set(os.listdir(base)) if os.path.isdir(base) else set()


def test_prompts_need_no_pair_table(spark, scratch):
    """A fresh session writes the prompts alone; where the pair table is there, it is read. Both give the same."""
    path, before = _tables(spark, scratch, DOCS), _folders(spark)
    since = len(session.WRITTEN_PLANS)
    once = sorted(r.text for r in catalog.q_write_prompt_corpus(spark, path).collect())
    assert "stage-pairs" not in dict(session.WRITTEN_PLANS[since:])
    assert [f.split("-")[0] for f in _folders(spark) - before] == ["prompts"]
    catalog._c(spark, path).pairs()
    since = len(session.WRITTEN_PLANS)
    assert once == sorted(r.text for r in catalog.q_write_prompt_corpus(spark, path).collect())
    assert len(once) > 50 and not session.WRITTEN_PLANS[since:]
    catalog._c(spark, path).close()
