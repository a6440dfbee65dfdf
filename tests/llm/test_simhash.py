import random

import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import queries
from corpusloom.llm import simhash as S


def naive_fingerprint(text, k=3):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(codes, most):
    parent = {c: c for c in codes}

    def find(c):
        while parent[c] != c:
            c = parent[c] = parent[parent[c]]
        return c

    ordered = list(parent)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= most:
                parent[find(a)] = find(b)
    return {c: find(c) for c in ordered}


def signed(c):
    return c - (1 << 64) if c >> 63 else c


def test_fingerprints(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in docs.collect()] + [None, "", " \t", "One", "one two", "ONE two three", "É é x y", "a\x0bb\x0cc d"]
    assert [S.fingerprint(t) for t in texts] == [naive_fingerprint(t) for t in texts]


@pytest.mark.parametrize("hot", [0, 3, 64])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    draw = random.Random(3)
    codes = {0, (1 << 64) - 1}
    codes |= {7 << 40 | 1 << b for b in range(32)} | {5 << 20 | 1 << b for b in range(32, 64)}  # many codes share a segment
    for _ in range(25):
        c = draw.getrandbits(64)
        for _ in range(draw.randint(1, 8)):
            codes.add(c)
            for _ in range(draw.randint(1, 3)):
                c ^= 1 << draw.randrange(64)
    df = spark.createDataFrame([(signed(c),) for c in codes], "code long")
    for most in (0, 1, 2):
        edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in S.links(df, most).collect()]
        assert all((a ^ b).bit_count() <= most and a != b for a, b in edges)
        want = components(codes, most)
        linked = dict.fromkeys(codes)
        parent = {c: c for c in codes}

        def find(c):
            while parent[c] != c:
                c = parent[c]
            return c

        for a, b in edges:
            parent[find(a)] = find(b)
        groups = lambda of: sorted(sorted(c for c in codes if of(c) == r) for r in {of(c) for c in codes})
        assert groups(find) == groups(want.get), most
        assert linked.keys() == codes


def test_a_segment_value_that_many_codes_share_lists_no_pairs(spark):
    draw = random.Random(8)
    codes = {9 << 32 | draw.getrandbits(32) for _ in range(3000)} | {8 << 32 | draw.getrandbits(32) for _ in range(3000)}
    df = spark.createDataFrame([(c,) for c in codes], "code long")
    found = {(r.a, r.b) for r in S.links(df, 2).collect()}
    ordered = sorted(codes)
    assert all((a ^ b).bit_count() <= 2 for a, b in found) and len(found) < len(codes)
    some = ordered[::50]
    linked = {frozenset(x) for x in found}
    for a in some:  # a pair within two bits is linked, if not by itself then over others
        for b in ordered:
            if 0 < (a ^ b).bit_count() <= 1:
                assert frozenset((a, b)) in linked or any(frozenset((a, c)) in linked for c in codes)


def test_labels_follow_long_chains(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r.node: r.label for r in S.component_labels(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100, 102: 100}


def test_documents_equal_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = queries.table(spark, d, "documents").select("doc_id", "text").collect()
    codes = {r.doc_id: naive_fingerprint(r.text) for r in docs}
    roots = components(set(codes.values()), 2)
    least = {}
    for i, c in codes.items():
        least[roots[c]] = min(i, least.get(roots[c], i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, d).collect()}
    assert got == {i: (f"{c:016x}", least[roots[c]]) for i, c in codes.items()}


def test_edges(spark, edge_docs, no_docs):
    rows = S.near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    of = {(r.id, r.digest): r.component_id for r in rows}
    blank = {r.component_id for r in rows if r.simhash == 0}
    assert blank == {2} and len(of) == len({(r.id, r.digest) for r in rows})
    assert S.near_duplicates(no_docs).count() == 0
    kept = S.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(found) == len(set(found)) and (6, "same text here, the same text") in found and (7, "same text here, the same text") not in found
    assert (2, None) in found and (3, "") not in found and (None, "a row without an id") in found
    assert S.keep_one(no_docs).count() == 0


def test_a_hot_group_of_copies_makes_no_pairs(spark):
    copies = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same text for everyone").alias("text"))
    rows = S.near_duplicates(copies)
    assert rows.where("component_id <> 0").count() == 0 and rows.count() == 3000
    assert S.keep_one(copies).count() == 1
