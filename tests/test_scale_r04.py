import os
import random

import pyarrow as pa

from corpusloom import session
from corpusloom.llm import simhash as S
from corpusloom.operators import prep as P
from corpusloom.operators import subword as W
from corpusloom.operators import tagger as T
from corpusloom.plans import evaluation as EV
from corpusloom.sources import corpus as IO


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _codes(spark):
    draw = random.Random(4)
    return spark.createDataFrame([(draw.getrandbits(64) - (1 << 63),) for _ in range(500)], "code long")


def test_near_codes_meet_without_a_broadcast(spark):
    """the balls are 16 rows a code, though Spark sizes them like the codes themselves."""
    for most in (1, 2):
        plan = _plan(S.links(session.materialize(_codes(spark), "test-codes"), most))
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, most


def test_the_pipelines_near_duplicates_meet_without_a_broadcast(spark):
    """the same links, where the stage writes them."""
    import corpus_pipeline
    draw = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    docs = spark.createDataFrame([(i, " ".join(draw.choices(words, k=12)), "en", "a", 0) for i in range(60)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    since = len(session.WRITTEN_PLANS)
    assert corpus_pipeline.remove_near_duplicates(spark, session.materialize(docs, "test-docs"), "").count() == 60
    plan = dict(session.WRITTEN_PLANS[since:])["edges"]
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_words_are_segmented_together_and_no_further_than_ids_are_kept(monkeypatch):
    """a batch's new words are segmented in one go, as ``segment`` does one by one, ties included; words beyond the
    limit are not looked at."""
    draw = random.Random(6)
    letters = "abcé"
    scores = {c: -3.0 for c in [*letters, W.MARK]}
    scores |= {"".join(draw.choices(letters + W.MARK, k=draw.randint(2, 8))): float(-draw.randint(2, 9)) for _ in range(200)}
    words = ["".join(draw.choices(letters, k=draw.randint(1, 30))) for _ in range(300)]
    encoder = W.Encoder(scores)
    want = [[encoder.number[p] - W.FIRST_PIECE_ID for p in W.segment(W.MARK + w, scores)[1]] for w in words]
    assert encoder.lattices.segments([W.MARK + w for w in words]) == want
    monkeypatch.setattr(W, "segment", lambda *a: 1 / 0)  # not word by word
    ids = [W.FIRST_PIECE_ID + i for w in want for i in w]
    assert encoder([" ".join(words)], 100) == [[*ids[:99], 1]] and encoder([" ".join(words)], 1) == [[1]]
    few = W.Encoder(scores)
    few([" ".join(words)], 4)
    assert len(few.known) == 3


def test_a_round_goes_through_a_block_of_words_at_once(monkeypatch):
    """F8: the sums are those of the words one by one, wherever blocks end."""
    draw = random.Random(7)
    scores = {c: -2.0 - draw.random() for c in "abc"} | {"".join(draw.choices("abc", k=draw.randint(2, 8))): -3 * draw.random() for _ in range(60)}
    words = ["".join(draw.choices("abc", k=draw.randint(1, 25))) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(words), pa.array([draw.randint(1, 9) for _ in words])], names=["word", "n"])
    want = {}
    for w, n in zip(*(c.to_pylist() for c in batch.columns)):
        whole, counts = W.expected(w, scores)
        for p, x in {**counts, "": whole}.items():
            want[p] = want.get(p, 0) + round(x * W.UNIT) * n
    calls, expected = [], W.Lattices.expected
    monkeypatch.setattr(W.Lattices, "expected", lambda self, some: calls.append(len(some)) or expected(self, some))
    for size in (1, 100, 100_000):
        monkeypatch.setattr(W, "BLOCK_LETTERS", size)
        calls.clear()
        (out,) = W._sums(scores)(iter([batch]))
        assert {p: n for p, n in zip(*(c.to_pylist() for c in out.columns))} == {p: n for p, n in want.items() if n}
    assert calls == [200]


def test_tokens_stay_in_their_buckets(spark):
    """only numbers are shuffled to be batched; rows are those of the join on record_id, repeated and odd ids too."""
    rows = [(i // 2, i, list(range(i % 7 + 1)), list(range(i % 5 + 1)) + [1]) for i in [*range(60), 7, 8]]
    tokens = spark.createDataFrame(rows, "pair_id long, record_id long, input_ids array<int>, labels array<int>")
    table = session.materialize(tokens.repartition(4, "pair_id"), "test-tokens", "pair_id", 4, placed=True)
    positions = spark.createDataFrame([(i // 2, i, "eval" if i % 9 == 0 else "train", i) for i in [*range(3, 60), 90]],
                                      "pair_id long, record_id long, split string, position long")
    made = P.shift_and_pad(table, positions, 8, partition_key="pair_id")
    plan = _plan(made)
    assert plan.count("Exchange hashpartitioning") == 3 and "Bucketed: true" in plan and "Broadcast" not in plan
    want = P.shift_and_pad(tokens.drop("pair_id"), positions.drop("pair_id"), 8)
    assert made.columns == want.columns and sorted(made.collect()) == sorted(want.collect()) and made.count() == 55 + 2 * 4


def test_tokens_that_are_read_once_are_not_written(spark):
    """tokenize_pairs writes the pairs and the vocabulary only, the bucketed ones well packed."""
    from corpusloom.plans.curation import Curation
    c, since = Curation(spark, "/root/testdata/sf0.001"), len(session.WRITTEN_PLANS)
    rows = EV.tokens(c)
    assert rows.columns == ["record_id", "input_ids", "labels", "decoder_input_ids"] and rows.count()
    assert "stage-tokens" not in dict(session.WRITTEN_PLANS[since:])
    assert all(".zstd." in f for f in c.pairs().inputFiles())
    c.close()


def test_a_comparison_is_written_packed(spark, scratch):
    """a sample's texts stand in a row a translator; all rows come back."""
    texts = [" blanks ", "", None, 'a "quote", and\na line']
    df = spark.createDataFrame([(t, "x" * 500, "en", "fr", f"m{i}", t, 0.5, None, 1.0) for t in texts for i in range(50)], IO.COMPARISON_SCHEMA)
    path = IO.write_comparison(df.coalesce(1), scratch, "r1")
    files = [f"{path}/{f}" for f in os.listdir(path) if f.startswith("part-")] if os.path.isdir(path) else []
    assert files and all(f.endswith(".csv.gz") for f in files) and sum(map(os.path.getsize, files)) < 200 * 100
    assert sorted(map(str, IO.read_scores(spark, path, IO.COMPARISON_SCHEMA).collect())) == sorted(map(str, df.collect()))


def test_a_tasks_token_is_looked_up_once(monkeypatch):
    """batches after the first find the classes of their tokens remembered, in training and in counting; the sums
    of several batches and blocks are those of their texts one by one."""
    draw, words = random.Random(9), ["athe", "Sthe", "aking", "Aparis", "0%7", ".!"]
    model = T.start_model({"a": 5, "A": 2, "S": 2, "aing": 2, ".": 1, "0": 1})
    texts = [[draw.choice(words) for _ in range(draw.randint(0, 9))] for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 40), pa.array(texts, pa.list_(pa.string()))], names=["lang", "tokens"])
    each = [list(T._expected({"en": model})(iter([batch.slice(i, 1)])))[0].to_pylist() for i in range(40)]
    want = {}
    for r in [r for rows in each for r in rows]:
        for tag in T.TAGS:
            want[r["slot"], tag] = want.get((r["slot"], tag), 0) + 3 * r[tag]
    asked, class_of = [], T.Hmm.class_of
    monkeypatch.setattr(T.Hmm, "class_of", lambda self, token: asked.append(token) or class_of(self, token))
    for size in (7, 400_000):
        monkeypatch.setattr(T, "BLOCK_TOKENS", size)
        asked.clear()
        (out,) = T._expected({"en": model})(iter([batch] * 3))
        assert {(r["slot"], t): r[t] for r in out.to_pylist() for t in T.TAGS} == want
        assert sorted(asked) == sorted(words)
