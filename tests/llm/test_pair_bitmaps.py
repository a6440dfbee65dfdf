import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpusloom.llm import pair_bitmaps as P
from corpusloom.llm import queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def spoken():
    """(token ids, token bytes) of a text by each library, without any cut into units."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = P.byte_letters()

    def of_a(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        return ids, [bytes(letters[c] for c in a.id_to_token(i)) for i in ids]

    def of_b(text):
        ids = b.encode(text)
        piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        return ids, [piece(i) for i in ids]
    return of_a, of_b


def brute(texts, spoken):
    documents, holders, found = [], defaultdict(set), []
    for d, text in enumerate(texts):
        links, groups, sizes = Counter(), [], (0, 0)
        if text:
            (ia, ba), (ib, bb) = spoken[0](text), spoken[1](text)
            want = (" " + text).encode()
            if b"".join(ba) == want and b"".join(bb) == want:
                sizes = len(ia), len(ib)
                ends = [set(np.cumsum([len(x) for x in t]).tolist()) for t in (ba, bb)]
                common, ga, gb = sorted(ends[0] & ends[1]), defaultdict(list), defaultdict(list)
                for ids, parts, into in ((ia, ba, ga), (ib, bb, gb)):
                    at = 0
                    for i, p in zip(ids, parts):
                        at += len(p)
                        into[next(c for c in common if c >= at)].append(i)
                for c in common:
                    groups.append(",".join(map(str, ga[c])) + "|" + ",".join(map(str, gb[c])))
                    links.update((x, y) for x in ga[c] for y in gb[c])
        for pair in links:
            holders[pair].add(d)
        found.append(links)
        documents.append([*sizes, len(groups), links.total(), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    best = defaultdict(int)
    for (a, _), docs in holders.items():
        best[a] = max(best[a], len(docs))
    return [(*row[:4], sum(n for p, n in links.items() if len(holders[p]) == best[p[0]]), sum(n * len(holders[p]) for p, n in links.items()), row[4])
            for row, links in zip(documents, found)]


def run(spark, texts, n=3):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(n)
    rows = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
            for r in P.align(df, A, B, pattern=public_tokenizers.PATTERN).collect()}
    return [rows[i] for i in range(len(texts))]


TEXTS = [None, "", " ", "  \n\t ", "a", "Hello world", "Hello  world\n the end. ", " leading and trailing ", "<|endoftext|> and <s> </s> <0x41>",
         "tab\tand ▁ inside", "日本語のテキスト と 한국어 и русский", "naïve — “quotes” 😀🏳️‍🌈 é", "aaaaaaaaaaaaaaaa " * 9, "word " * 50,
         "x" * 3000, "\x1c \x1d a   b 　 c", "a b \r\n c", "'s 't it's we'll 've", "1234567890 " * 3, "Hello world", "Hello world"]


def test_equals_brute_force(spark, spoken):
    rng = random.Random(3)
    pieces = ["Hello", "world", " ", "  ", "\n", "é", "1", ".", "thé", "▁", "\x01", "的", "\t", "'s", "un", "expected"]
    texts = TEXTS + ["".join(rng.choices(pieces[:9] if i % 3 else pieces, k=rng.randint(1, 25))) for i in range(120)]
    assert run(spark, texts) == brute(texts, spoken)


def test_small_blocks_parts_and_large_groups_change_nothing(spark, spoken, monkeypatch):
    want = brute(TEXTS, spoken)
    t = P.Tokenizers(open(A, encoding="utf-8").read(), open(B, "rb").read())  # without the faster library
    units = P.Units(t)
    monkeypatch.setattr(P, "PART_CHARS", 7)
    monkeypatch.setattr(P, "LISTED_LINKS", 1)
    monkeypatch.setattr(P, "REMEMBERED", 5)
    block = P.Block(units)
    for i, text in enumerate(TEXTS):
        block.add([i], [text])
    assert [(*r[1:5], r[5]) for r in block.rows] == [(*w[:4], w[6]) for w in want]
    keys, links = P.summed(np.concatenate(block.keys), np.concatenate(block.links))
    slot = (keys & np.uint64(P.SLOTS - 1)).astype(int)
    assert [int(links[slot == i].sum()) for i in range(len(TEXTS)) if i not in block.bad] == [w[3] for i, w in enumerate(want) if i not in block.bad]


def test_planes_are_an_exact_round_trip():
    rng = np.random.default_rng(1)
    keys = np.unique(np.concatenate([rng.integers(0, 40 << 12, 3000), (7 << 12) + np.arange(P.SLOTS), (9 << 12) + np.arange(0, P.SLOTS, 3)]))
    links = rng.choice([1, 1, 1, 2, 3, 700], len(keys))
    pair, docs, total, begin, words = P.pack(keys >> 12, keys & 4095, links)
    got = np.zeros((len(pair), P.SLOTS), np.int64)
    for row, slot, weight in P.unpack(begin[:-1], begin[1:], words):
        np.add.at(got, (row, slot), weight)
    want = np.zeros((40, P.SLOTS), np.int64)
    want[keys >> 12, keys & 4095] = links
    assert (got == want[pair]).all()
    assert (docs == (got > 0).sum(1)).all() and (total == got.sum(1)).all()
    assert len(words) < len(keys) * 3  # the full pair takes bit sets


def test_documents_table_in_any_partitioning(spark, spoken):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    texts = [r.text for r in docs.collect()]
    want = brute(texts, spoken)
    assert run(spark, texts, 1) == want and run(spark, texts, 7) == want


def test_pair_counts_and_edges(spark, edge_docs, no_docs):
    encoded = P.materialize(P.encode(edge_docs, A, B), "test-pairs")
    counts = P.pair_counts(encoded).collect()
    out = P.align(edge_docs, A, B).collect()
    assert len(out) == edge_docs.count() and sum(r.n_links for r in out) == sum(r.n_links for r in counts)
    assert {r.n_a for r in out if r.doc_id in (2, 3)} == {0} and max(r.n_docs for r in counts) <= len(out)
    assert P.align(no_docs, A, B).count() == 0


def test_query_plan_keeps_postings_compressed(spark):
    frame = queries.op11_pair_bitmaps(spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
