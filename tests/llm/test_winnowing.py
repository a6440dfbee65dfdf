import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import winnowing as W


def naive(text, k, w):
    """Chosen positions: the rightmost smallest hash of every window, by the hashes of the operator."""
    if not text:
        return []
    k = min(k, len(text))
    grams = [text[i:i + k] for i in range(len(text) - k + 1)]
    hashes = [int(W.winnow(g, k, 1)[0][0]) >> 32 for g in grams]
    w = min(w, len(grams))
    chosen = {max(range(i, i + w), key=lambda p: (-hashes[p], p)) for i in range(len(grams) - w + 1)}
    return sorted(chosen)


@settings(max_examples=150, deadline=None)
@given(st.text("abé😀 ", max_size=60), st.integers(1, 6), st.integers(1, 9))
def test_windows_equal_naive(text, k, w):
    hashes, positions = W.winnow(text, k, w)
    assert positions.tolist() == naive(text, k, w) and len(hashes) == len(positions)


@settings(max_examples=80, deadline=None)
@given(st.text("abcd", max_size=40), st.text("abcd", max_size=40), st.text("abcd", min_size=10, max_size=20))
def test_a_passage_of_k_plus_w_minus_1_is_always_found(before, after, shared):
    k, w = 4, 7
    a, b = W.winnow(before + shared, k, w), W.winnow(shared + after, k, w)
    assert set(a[0].tolist()) & set(b[0].tolist())


def test_rightmost_of_equal_hashes():
    assert W.winnow("aaaaaaaa", 2, 3)[1].tolist() == [2, 3, 4, 5, 6]


def brute(rows):
    order = sorted(rows, key=lambda r: -r[0])
    for i, (doc_id, text) in enumerate(order):
        follower = order[(i + 1) % len(order)][1] or ""
        text = text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + follower[:half]
        f, g, h = (W.winnow(x) for x in (text, edited, follower))
        like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if len(a) or len(b) else 1.0
        yield doc_id, (len(text), hashlib.sha256(edited.encode()).hexdigest(), W.digest(*f), W.digest(*g),
                       like(f[0].tolist(), g[0].tolist()), like(f[0].tolist(), h[0].tolist()))


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(1001, None), (1002, ""), (1003, "x"), (-4, "ab" * 30_000)], docs.schema))
    want = dict(brute([tuple(r) for r in docs.collect()]))
    got = {r.id: tuple(r)[1:] for r in W.compare_edits(docs.repartition(5)).collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:4] == want[i][:4] and np.allclose(got[i][4:], want[i][4:]), i


def test_edges(spark, edge_docs, no_docs):
    out = W.compare_edits(edge_docs).collect()
    assert sorted((r.id is None, r.id, r.n_chars) for r in out) == sorted((r.doc_id is None, r.doc_id, len(r.text or "")) for r in edge_docs.collect())
    assert W.compare_edits(no_docs).count() == 0
    one = W.compare_edits(edge_docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    found = W.fingerprints(edge_docs).where("doc_id = 1").first()
    assert len(found.hashes) == len(found.positions) > 0
