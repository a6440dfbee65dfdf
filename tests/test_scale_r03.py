import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.functions import text as T
from corpusloom.operators import accent as A
from corpusloom.operators import prep as P
from corpusloom.operators import subword as W
from corpusloom.operators.encoder import trigram_embeddings


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


ROWS = [(0, "en", "a b  c\x1cd", "le chat"), (0, "en", "a b  c\x1cd", "le chat"), (1, "fr", None, " le chien "), (2, "fr", "x", " \t"),
        (3, None, "", "a " * 30), (4, "en", "new words", None), (5, "fr", "b a", "c")]


def _records(spark):
    return spark.createDataFrame(ROWS, "record_id long, source_lang string, source string, target string")


def test_tokens_are_looked_up_in_place(spark, monkeypatch):
    """A small vocabulary: no token row is made, shuffled or gathered; ids are those of the join with a large one."""
    recs = _records(spark)
    vocab = P.word_vocabulary(recs.where("record_id != 4"))
    made = P.tokenize_records(recs, vocab, 4, 6)
    assert not re.search(r"Generate|Aggregate|Exchange", _plan(made))
    got = sorted(made.collect())
    monkeypatch.setattr(P, "VOCAB_BROADCAST_MAX_ROWS", 1)
    assert got == sorted(P.tokenize_records(recs, vocab, 4, 6).collect()) and len(got) == 5


def test_token_counts_are_those_of_split(spark):
    want = {}
    for _, _, s, t in ROWS:
        for w in ((s or "") + " " + (t or "")).split():
            want[w] = want.get(w, 0) + 1
    assert {r.token: r.n for r in P.token_counts(_records(spark), ("source", "target")).collect()} == want
    assert P.token_counts(_records(spark).limit(0), ("source",)).count() == 0


def test_lists_are_not_worked_out_again_in_filters(spark):
    rows = spark.createDataFrame([(1, "été (été) a"), (2, None), (3, "")], "pair_id long, fr string")
    counts = A.accent_counts(rows)
    assert "size(" not in _plan(counts)
    assert [(r.accented, r["count"]) for r in counts.collect()] == [("été", 2)]


def test_white_space_needs_no_pattern_per_row(spark):
    df = spark.createDataFrame([("a\x1cb　c \x85",), ("",), (None,)], "t string").select(T.whitespace_tokens("t").alias("w"), T.py_strip("t").alias("s"))
    assert "(?U)" not in _plan(df)
    assert [tuple(r) for r in df.collect()] == [(["a", "b", "c"], "a\x1cb　c"), ([], ""), (None, None)]


@pytest.mark.parametrize("name", ["i", "s", "k", "f", "é"])
def test_either_case_matches_what_folding_does(spark, name):
    df = spark.range(1, 0xD800).select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    assert df.where(F.col("c").rlike(f"(?iU){name}") != F.col("c").rlike(T.either_case(name))).count() == 0


def test_cosines_are_made_once_per_choice_of_vectors(spark):
    from corpusloom.plans import evaluation as EV
    from corpusloom.plans.curation import Curation
    c, since = Curation(spark, "/root/testdata/sf0.001"), len(session.WRITTEN_PLANS)
    assert EV.scores(c).count() == 4 * c.pairs().count()
    assert "Aggregate(keys=[src_vec_id" in dict(session.WRITTEN_PLANS[since:])["stage-comparison"].replace("HashAggregate", "Aggregate").replace("ObjectAggregate", "Aggregate")
    c.close()


def test_words_of_a_small_table_are_dealt_to_all_cores(spark):
    seen = []
    mine = W.materialize
    try:
        W.materialize = lambda df, name, *a: seen.append((name, mine(df, name, *a))) or seen[-1][1]
        W.train(spark.createDataFrame([(" ".join(f"w{i}" for i in range(300)),)], "text string"), 30, rounds=1)
    finally:
        W.materialize = mine
    words = dict(seen)["subword-words"]
    assert words.select(F.input_file_name().alias("f")).distinct().count() > 1


def test_trigrams_are_counted_by_batch(spark):
    texts = ["", "ab", "abab\U0001f600", "é" * 50]
    got = {r.text: r.vec for r in trigram_embeddings(spark.createDataFrame([(t,) for t in [*texts, "ab", None]], "text string"), 8).collect()}
    for t in texts:
        n, s = [0.0] * 8, f"  {t}  "
        for i in range(len(s) - 2):
            n[int(hashlib.md5(s[i:i + 3].encode()).hexdigest()[:8], 16) % 8] += 1
        assert got.pop(t) == pytest.approx([x / sum(y * y for y in n) ** 0.5 for x in n], abs=1e-12)
    assert not got
