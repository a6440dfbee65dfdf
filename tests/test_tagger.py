import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import gates as G
from corpusloom.operators import tagger as T
from corpusloom.plans import catalog
from corpusloom.plans.curation import COUNT_COLUMNS, curate


def random_model(rng, n_classes=3, zeros=False):
    def rows(n, m):
        x = rng.random((n, m))
        if zeros:
            x[rng.random((n, m)) < 0.2] = 0
            x[:, 0] += 0.1
        return x / x.sum(-1, keepdims=True)
    t = len(T.TAGS)
    return T.Hmm({str(i): i for i in range(n_classes)}, rows(1, t)[0], rows(t, t), rows(t, n_classes))


def paths(model, text):
    """Every tag path of a text, with its probability."""
    for tags in itertools.product(range(len(T.TAGS)), repeat=len(text)):
        p = 1.0
        for i, (c, t) in enumerate(zip(text, tags)):
            p *= (model.start[t] if i == 0 else model.trans[tags[i - 1], t]) * model.emit[t, c]
        yield tags, p


@pytest.mark.parametrize("seed", range(4))
def test_forward_backward_and_viterbi_equal_enumeration(seed):
    rng = np.random.default_rng(seed)
    model = random_model(rng, zeros=seed % 2 == 1)
    texts = [rng.integers(0, 3, n).tolist() for n in (3, 1, 0, 5, 2, 5, 0)]
    flat, lengths = np.array([c for t in texts for c in t]), np.array([len(t) for t in texts])
    each, joint, share = T.forward_backward(model, flat, lengths)
    best, at = T.viterbi(model, flat, lengths), 0
    for text in filter(None, texts):
        n, every = len(text), list(paths(model, text))
        total = sum(p for _, p in every)
        assert np.isclose(share[at:at + n].sum(), np.log(total))
        for i in range(n):
            for t in range(len(T.TAGS)):
                assert np.isclose(each[at + i, t], sum(p for tags, p in every if tags[i] == t) / total)
                for u in range(len(T.TAGS)) if i + 1 < n else ():
                    assert np.isclose(joint[at + i, t, u], sum(p for tags, p in every if tags[i:i + 2] == (t, u)) / total)
        assert not joint[at + n - 1].any()
        found = dict(every)[tuple(best[at:at + n].tolist())]
        assert np.isclose(found, max(p for _, p in every))
        at += n


SAID = ["The king walked to Paris.", "A nation of happiness was ending", "Running and jumping, he tired", None, "", "12 % !!",
        "London greeted the movement", "Le développement mangé à Lyon", "naïve l'eau aujourd'hui — ÉTÉ"]


def corpus(spark, n=120):
    rng = random.Random(1)
    rows = [(i, rng.choice(SAID), rng.choice(SAID), 0.8) for i in range(n)]
    return spark.createDataFrame(rows, "pair_id long, fr string, en string, similarity double")


def sides(pairs):
    side = lambda c: pairs.select(F.lit(c).alias("lang"), F.col(c).alias("text"))
    return side("fr").union(side("en"))


def test_training_never_falls_and_does_not_depend_on_partitions(spark):
    pairs = corpus(spark)
    one = T.train(sides(pairs.repartition(1)), rounds=6, min_share=1e-3)
    many = T.train(sides(pairs.repartition(7)), rounds=6, min_share=1e-3)
    assert len(one.history) == 6 and all(b >= a - 1e-3 for a, b in zip(one.history, one.history[1:]))
    assert one.history[-1] > one.history[0]
    for lang in ("fr", "en"):
        a, b = one.models[lang], many.models[lang]
        assert a.classes == b.classes and (a.emit == b.emit).all() and (a.trans == b.trans).all() and (a.start == b.start).all()
        assert np.allclose(a.emit.sum(1), 1) and np.allclose(a.trans.sum(1), 1)


def test_a_round_is_baum_welch(spark):
    """One round without smoothing equals expected counts from enumerating every tag path."""
    texts = [(lang, t) for lang, t in (("en", "He walked"), ("en", "the nation"), ("en", "Walked"))]
    df = spark.createDataFrame(texts, "lang string, text string")
    start = T.start_model(T.suffix_trie(df.select("lang", T.token_forms(F.col("text")).alias("tokens")), 0.0)["en"])
    forms = [r.tokens for r in df.select(T.token_forms(F.col("text")).alias("tokens")).collect()]
    emit, first = np.zeros_like(start.emit), np.zeros(len(T.TAGS))
    for f in forms:
        every = list(paths(start, [start.class_of(x) for x in f]))
        total = sum(p for _, p in every)
        for tags, p in every:
            first[tags[0]] += p / total
            for x, t in zip(f, tags):
                emit[t, start.class_of(x)] += p / total
    got = T.train(df, rounds=1, min_share=0.0, smoothing=0.0).models["en"]
    assert np.allclose(got.emit, emit / emit.sum(1, keepdims=True), atol=1e-5) and np.allclose(got.start, first / first.sum(), atol=1e-5)


def test_tokens_and_trie(spark):
    df = spark.createDataFrame([("en", "Le Roi l'eau 3 % ÉTÉ"), ("en", None), ("en", "")], "lang string, text string")
    forms = [r.f for r in df.select(T.token_forms(F.col("text")).alias("f")).collect()]
    assert forms == [["Sle", "Aroi", "al'eau", "03", ".%", "Aété"], None, []]
    model = T.Hmm({"": 0, "a": 1, "aing": 2, "a^sing": 3, "ag": 4}, None, None, None)
    assert [model.class_of(x) for x in ("asing", "aking", "adog", "adogs", "Adog", "aing")] == [3, 2, 4, 1, 0, 2]


def test_counts_of_missing_empty_and_long_texts(spark):
    tagger = T.train(sides(corpus(spark)), rounds=1)
    odd = spark.createDataFrame([(1, None, ""), (2, "walked " * 250_000, "x"), (2, "the", None)], "pair_id long, fr string, en string")
    rows = sorted(map(tuple, T.count_tags(odd, tagger).collect()), key=repr)
    assert [r[0] for r in rows] == [1, 2, 2] and rows[0][1:] == (None, None, None, 0, 0, 0)
    assert max(sum(r[1:4]) for r in rows[1:]) <= 250_000
    assert T.count_tags(odd.limit(0), tagger).count() == 0
    assert T.train(sides(odd.limit(0))).models == {}


def test_curate_follows_the_tagger(spark):
    pairs = corpus(spark, 60)
    lexicon = spark.createDataFrame([("eau",)], "word string")
    plain, learned = curate(spark, pairs, lexicon), curate(spark, pairs, lexicon, tagger="learn")
    counts = learned.counts()
    assert set(counts.columns) == {"pair_id", *COUNT_COLUMNS} and counts.count() == 60
    given = curate(spark, pairs, lexicon, tagger=learned.learned_tagger())
    ratios = lambda c: sorted((r.pair_id, r.verb_ratio, r.noun_ratio, r.entity_ratio) for r in c.features_pre().collect())
    assert ratios(given) == ratios(learned) != ratios(plain)
    flags = lambda c: {r.pair_id for r in G.training_pairs(c.gated()).collect()}
    assert flags(given) == flags(learned) and flags(learned) != flags(plain)
    with pytest.raises(ValueError, match="both replace"):
        curate(spark, pairs, lexicon, counts=counts, tagger="learn")


def test_registered_queries(spark):
    counts = catalog.QUERIES["tagger_counts"](spark, "/root/testdata/sf0.001").collect()
    gate = catalog.QUERIES["tagger_gate"](spark, "/root/testdata/sf0.001")
    plain = {r.pair_id for r in catalog.QUERIES["training_gate"](spark, "/root/testdata/sf0.001").collect()}
    assert len(counts) == gate.count() and plain
    assert 0 < gate.where("passed").count() < len(counts)
