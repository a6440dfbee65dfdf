import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import queries
from corpusloom.llm import toxicity as T


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_levenshtein_distance():
    draw = random.Random(1)
    for _ in range(60):
        terms = ["".join(draw.choices("abc", k=draw.randint(2, 8))) for _ in range(draw.randint(1, 12))]
        matcher = T.Matcher(terms)
        words = ["".join(draw.choices("abcd", k=draw.randint(1, 9))) for _ in range(60)] + terms
        cps, begins, ends, _ = T.words_of([" ".join(words)])
        hit, term, edits = matcher.match(cps, begins, ends)
        found = {w: (matcher.terms[t], e) for w, t, e in zip(hit.tolist(), term.tolist(), edits.tolist())}
        for i, w in enumerate(words):
            best = min(distance(w, t) for t in terms if len(t) >= T.FUZZY_LENGTH or t == w) if any(len(t) >= T.FUZZY_LENGTH or t == w for t in terms) else 9
            assert (i in found) == (best <= 1), (w, terms)
            if i in found:
                assert found[i][1] == best and distance(w, found[i][0]) == best


def test_alphabet_of_any_size():
    letters = [chr(0x4E00 + i) for i in range(420)]
    terms = ["".join(letters[i:i + 3]) for i in range(0, 300, 3)] + ["".join(letters[i:i + 6]) for i in range(300, 420, 6)]
    matcher = T.Matcher(terms)
    clean = [t[:-1] + "x" for t in terms if len(t) == 3] + [t[:2] + "xy" + t[4:] for t in terms if len(t) == 6]
    wrong = [t[:2] + "x" + t[3:] for t in terms if len(t) == 6]
    words = terms + clean + wrong
    cps, begins, ends, _ = T.words_of([" ".join(words)])
    hit, term, edits = matcher.match(cps, begins, ends)
    found = {words[w]: (matcher.terms[t], int(e)) for w, t, e in zip(hit, term, edits)}
    assert found == {**{t: (t, 0) for t in terms}, **{w: (t, 1) for w, t in zip(wrong, terms[100:])}}


def x_of(text, terms=("idiot", "scum")):
    return dict(zip(T.FEATURES, T.features([text], T.Matcher(list(terms)), T.Matcher(T.REPORTING))[0]))


def test_misspellings_and_context():
    one = np.log1p(1)
    assert x_of("you IDIOT!")["plain_exact"] == one
    assert x_of("you idoit id1ot")["plain_fuzzy"] == one  # one letter changed; two are changed in the first
    assert x_of("scun scu scums")["plain_fuzzy"] == 0  # short terms are matched exactly
    assert x_of('he wrote "what an idiot" to me')["quoted_exact"] == one
    assert x_of("she called me an idiot")["quoted_exact"] == one
    assert x_of('an "open quote is no quotation of an idiot')["plain_exact"] == one
    assert x_of('"a"\nidiot "b"')["plain_exact"] == one  # quotes count within the line
    assert x_of("idiot scum idiot")["densest"] == np.log1p(3) and x_of("idiot scum idiot")["terms"] == np.log1p(2)


def test_features_do_not_depend_on_the_block():
    texts = ["idiot here", None, "", "nothing", 'said "scum" x\n' * 30, "scum " * 5, "an idiot\nan idiit"]
    a, b = T.Matcher(["idiot", "scum"]), T.Matcher(T.REPORTING)
    assert np.allclose(T.features(texts, a, b), np.concatenate([T.features([t], a, b) for t in texts]))


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (6, None), (None, 1)], "doc_id long, toxic int")
    for model in (T.train(edge_docs, labels), T.train(no_docs, labels), T.train(edge_docs, labels.limit(0))):
        out = T.score_toxicity(edge_docs, model).collect()
        assert len(out) == edge_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
        assert len({r.score for r in out if not (r.text or "").strip()}) == 1
    assert T.score_toxicity(no_docs, model).count() == 0


def test_labels_are_learned_and_held_out_rows_are_scored(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op6_toxicity(spark, d).join(queries.table(spark, d, "labels"), "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.85 and n.get((0, 1), 0) / n[0, 0] < 0.04


def test_scores_read_nothing_but_the_text(spark, edge_docs):
    model = T.Model(sorted(T.SEED_TERMS), T.DEFAULT_WEIGHTS)
    a = T.score_toxicity(edge_docs, model).select("text", "score").collect()
    b = T.score_toxicity(edge_docs.withColumn("doc_id", F.lit(1)).withColumn("lang", F.lit("x")), model).select("text", "score").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
