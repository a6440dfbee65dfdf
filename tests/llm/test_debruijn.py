import hashlib
import random
import re

import numpy as np
import pytest

from corpusloom.llm import debruijn as D
from corpusloom.llm import queries


def brute(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        if i is not None:
            for p in range(len(w) - 49):
                key = tuple(w[p:p + 50])
                least[key] = min(i, least.get(key, i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for p in range(len(w) - 49) if i is not None else ():
            if least[tuple(w[p:p + 50])] < i:
                gone[p:p + 50] = [True] * 50
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(map(repr, out))


def run(spark, rows, n=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
    return sorted(repr(tuple(r)) for r in D.remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def corpus(seed, n=60):
    """Documents that share passages, whole copies, edited copies, loops and short repeats."""
    rng = random.Random(seed)
    say = lambda k, size=400: [f"w{rng.randrange(size)}" for _ in range(k)]
    shared = [say(rng.randint(45, 160)) for _ in range(6)]
    rows = []
    for i in range(n):
        w = say(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 20)
            w += s[a:len(s) - rng.randint(0, 20)] + say(rng.randint(0, 10))
        if rows and rng.random() < 0.4:
            w = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = "edited"
        if rng.random() < 0.1:
            w += ["loop", "de", "loop"] * rng.randint(10, 60)
        rows.append((rng.randrange(1000), rng.choice([" ", "\n", "\t "]).join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    rows += [(None, rows[0][1]), (None, None), (5, None), (6, ""), rows[3], rows[3], (rows[3][0], rows[4][1]), (-7, rows[5][1])]
    assert run(spark, rows) == brute(rows)


def test_parts_of_long_texts_change_nothing(spark, monkeypatch):
    rows = corpus(9, 30)
    text = "\n".join(t for _, t in rows)
    rows += [(2000, text), (2001, "x" + text), (1, text[40:])]
    want = brute(rows)
    assert run(spark, rows) == want
    monkeypatch.setattr(D, "PART_CHARS", 100)
    monkeypatch.setattr(D, "PART_WORDS", 70)
    hashes, owner = D.word_hashes([t for _, t in rows])
    assert len(hashes) == sum(len((t or "").split()) for _, t in rows) and (np.diff(owner) >= 0).all()
    runs = [np.concatenate(c) for c in zip(*D.anchored_runs(hashes, owner))]
    windows = sorted((d, p + k) for d, p, n in zip(*runs[:3]) for k in range(n))
    assert windows == [(i, p) for i, (_, t) in enumerate(rows) for p in range(len((t or "").split()) - 49)]


def test_paths_are_whole_passages_of_their_source(spark):
    rng = random.Random(4)
    say = lambda k: [f"v{rng.randrange(10 ** 6)}" for _ in range(k)]
    passage = say(300)
    rows = [(i, " ".join(say(60) + passage + say(60))) for i in range(8)]
    _, paths, spans = D.repeated(spark.createDataFrame(rows, "doc_id long, text string"))
    found = paths.collect()
    assert len(found) == 1 and found[0].id == 0 and found[0].copies == 8
    assert 60 <= found[0].place and found[0].place + found[0].n_words <= 360 and found[0].n_words > 250
    assert sorted(r.id for r in spans.collect()) == list(range(1, 8))
    assert run(spark, rows) == brute(rows)


def test_documents_table_and_edges(spark, edge_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = queries.op13_debruijn(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert sorted(repr(tuple(r)) for r in D.remove_repeats(edge_docs).collect()) == brute(rows)
    assert D.remove_repeats(no_docs).count() == 0
