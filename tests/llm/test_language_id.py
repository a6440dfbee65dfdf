import itertools

import numpy as np

from corpusloom.llm import language_id as L
from corpusloom.llm import queries
from corpusloom.llm.arrow import held_out

EN = "the house and the garden with those other things that they were thinking about".split()
DE = "der hund und die katze mit einem großen haus auf der straße gegen den wind".split()


def _model(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(w, 12)), lang) for i, (lang, w) in enumerate([("en", EN), ("de", DE)] * 60)]
    return L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    b = L.Block(["ab cd ef gh\nxy"])
    scores, moves = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    p, pairs, log_z = b.forward_backward(scores, moves)
    z, want, moved = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for path in itertools.product(range(3), repeat=4):
        v = np.exp(sum(scores[i, k] for i, k in enumerate(path)) + sum(moves[a, c] for a, c in zip(path, path[1:])))
        z += v
        for i, k in enumerate(path):
            want[i, k] += v
        for a, c in zip(path, path[1:]):
            moved[a, c] += v
    alone = np.exp(scores[4])
    assert np.allclose(p[:4], want / z) and np.allclose(p[4], alone / alone.sum())
    assert np.allclose(pairs, moved / z) and np.isclose(log_z, np.log(z) + np.log(alone.sum()))


def test_words_of_code_switched_text_get_their_own_labels(spark):
    tags = [t for _, t, _ in L.predict_words(_model(spark), "the house and the garden und die katze mit einem hund")]
    assert tags == ["en"] * 5 + ["de"] * 6


def test_scores_equal_a_sum_over_each_word(spark):
    m = _model(spark)
    b = L.Block(["Der Hund, the garden!"])
    got = b.scores(m)
    for i, (s, e) in enumerate(zip(b.begins, b.ends)):
        want = m.words[b.word_rows(m.lexicon)[i]].astype(float).copy()
        for k, n in enumerate(L.ORDERS):
            grams = b.grams(n)
            for at in range(s - 1, e + 2 - n):
                want += m.grams[k * L.BUCKETS + grams[at]]
        assert np.allclose(got[i], want, atol=1e-5)


def test_edge_cases(spark, edge_docs, no_docs):
    m = _model(spark)
    out = L.label_languages(edge_docs, m)
    assert len(out.columns) == len(edge_docs.columns) + 2  # score and Lang_Pred are replaced
    rows = out.collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1 and (letters or r.score == 0)
    assert L.label_languages(no_docs, m).count() == 0
    nothing = L.train(no_docs)
    assert {r.lang_pred for r in L.label_languages(edge_docs, nothing).collect()} == {"und"}


def test_long_lines_are_cut_into_chains_that_cover_all_words():
    b = L.Block([" ".join(["word"] * 1000), "one two\nthree"])
    assert sorted(i for rows in b.steps() for i in rows) == list(range(1003)) and b.lengths.max() == L.CHAIN


def test_more_than_a_hundred_languages_are_all_learned(spark):
    rng = np.random.default_rng(4)
    names = [f"l{k:03d}" for k in range(120)]
    lists = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(6)] for _ in names]
    rows = [(4 * k + i, " ".join(rng.choice(lists[k], 6)), names[k]) for k in range(120) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = L.train(df, rounds=12)
    assert m.labels == names
    got = L.label_languages(df, m).collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.9


def test_sample_of_a_language_shrinks_with_their_number():
    assert L._sample_size(4, 150, 4, 20) == (150, 4) == L._sample_size(20, 150, 4, 20)
    for n in (30, 60, 100, 300, 1000):
        docs, chains = L._sample_size(n, 150, 4, 20)
        assert docs >= L.LEAST_DOCS and chains >= 1 and docs * chains <= max(600 * (20 / n) ** 2 + 1e-6, L.LEAST_DOCS)


def test_held_out_accuracy_of_the_query(spark):
    d = "/root/testdata/sf0.01"
    docs = queries.table(spark, d, "documents")
    got = queries.op1_language_id(spark, d).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def test_held_out_is_crc32_of_the_id_as_text(spark):
    import zlib
    df = spark.createDataFrame([(i,) for i in [*range(200), None]], "doc_id long")
    for r in df.select("doc_id", held_out().alias("h")).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
