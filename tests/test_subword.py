import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import subword as W


def cuts(word):
    """Every segmentation."""
    if not word:
        yield []
    for i in range(1, len(word) + 1):
        for rest in cuts(word[i:]):
            yield [word[:i], *rest]


def random_scores(rng, letters="abc"):
    pieces = {c: rng.random() + 0.05 for c in letters}
    for _ in range(12):
        p = "".join(rng.choices(letters, k=rng.randint(2, 4)))
        pieces[p] = rng.random()
    total = sum(pieces.values())
    return {p: math.log(x / total) for p, x in pieces.items()}


@pytest.mark.parametrize("seed", range(5))
def test_lattice_equals_every_segmentation(seed):
    rng = random.Random(seed)
    scores = random_scores(rng)
    for _ in range(20):
        word = "".join(rng.choices("abc", k=rng.randint(1, 9)))
        every = [c for c in cuts(word) if all(p in scores for p in c)]
        weigh = lambda c: math.exp(sum(scores[p] for p in c))
        total = sum(map(weigh, every))
        whole, counts = W.expected(word, scores)
        assert math.isclose(whole, math.log(total), abs_tol=1e-9)
        for p in scores:
            assert math.isclose(counts.get(p, 0.0), sum(weigh(c) * c.count(p) for c in every) / total, abs_tol=1e-9)
        best, pieces = W.segment(word, scores)
        assert math.isclose(best, max(math.log(weigh(c)) for c in every), abs_tol=1e-9) and "".join(pieces) == word
    assert W.expected("axb", scores) == (-math.inf, {}) and W.segment("axb", scores) == (-math.inf, [])


def corpus(spark):
    rng = random.Random(3)
    stems, ends = ["walk", "talk", "jump", "déve", "natur"], ["ing", "ed", "er", "s", "", "ment"]
    texts = [" ".join(rng.choice(stems) + rng.choice(ends) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    return spark.createDataFrame([(t,) for t in [*texts, None, "", "  \t", "日本 é"]], "text string")


def test_training(spark):
    texts = corpus(spark)
    model = W.train(texts.repartition(1), 60)
    assert model == W.train(texts.repartition(7), 60)  # ids don't depend on partitions
    size = lambda h: h[0]
    for a, b in zip(model.history, model.history[1:]):
        assert size(a) != size(b) or b[1] >= a[1] - 1e-2  # the likelihood doesn't fall while the vocabulary stays
    characters = {c for r in texts.collect() for w in (r.text or "").split() for c in w} | {W.MARK}
    assert characters <= set(model.scores) and len(model.scores) <= max(60, len(characters))
    assert math.isclose(sum(map(math.exp, model.scores.values())), 1.0, abs_tol=1e-6)
    assert list(model.scores) == sorted(model.scores, key=lambda p: (-model.scores[p], p))
    assert any(len(p) > 3 for p in model.scores)  # stems or endings were found


def test_encoding_is_whole_and_has_no_unknown(spark):
    model = W.train(corpus(spark), 60)
    encoder = W.Encoder(model.scores)
    for text in ["walking talker", "unseen Ω😀 words", "", " a  b ", "日本"]:
        ids = encoder.text(text)
        assert encoder.decode(ids) == " ".join(text.split())
        assert all(i >= W.FIRST_BYTE_ID for i in ids)
    for word in ("walking", "naturment", "déveer"):
        best = max((sum(model.scores[p] for p in c) for c in cuts(W.MARK + word) if all(p in model.scores for p in c)))
        got = [list(model.scores)[i - W.FIRST_PIECE_ID] for i in encoder.word(word)]
        assert "".join(got) == W.MARK + word and math.isclose(sum(model.scores[p] for p in got), best, abs_tol=1e-9)
    assert len(encoder.text("walk" * 50_000)) > 10_000  # one unbroken word


def test_records(spark):
    model = W.train(corpus(spark), 60)
    recs = spark.createDataFrame([(1, "walking ed", "talker", "fr"), (1, "s", "jumps", "en"), (2, None, "walk", "en"), (3, "walk", " ", "en"), (4, "walk", None, "en")],
                                 "record_id long, source string, target string, source_lang string")
    rows = sorted(map(tuple, W.tokenize_subwords(recs, model, 5, 4).collect()), key=repr)
    assert [r[0] for r in rows] == [1, 1, 2]  # rows that share an id stay apart; empty targets go
    for _, ids, labels, decoder in rows:
        assert len(ids) <= 5 and len(labels) <= 4 and ids[-1] == labels[-1] == 1 and decoder[1:] == labels[:-1]
    empty = W.train(recs.select(F.col("source").alias("text")).limit(0), 50)
    assert empty.scores == {} and W.Encoder({}).decode(W.Encoder({}).text("é x")) != ""
