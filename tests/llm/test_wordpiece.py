import json
import random

import numpy as np
import public_tokenizers

from corpusloom.llm import wordpiece as W
from corpusloom.llm.bpe import byte_letters

PATH = public_tokenizers.path("byte_bpe_50k.json")


def naive(word, begins, continues):
    at = n = 0
    tokens = begins
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in tokens), None)
        if end is None:
            return -1
        at, n, tokens = end, n + 1, continues
    return n


def counts(machine, words):
    lengths = np.array([len(w) for w in words])
    ends = np.cumsum(lengths + 1)
    return machine.count(np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8), ends - lengths, ends).tolist()


def test_random_vocabularies_equal_naive_matching():
    draw = random.Random(2)
    for _ in range(300):
        begins, continues = ({bytes(draw.choices(b"abc", k=draw.randint(1, 5))) for _ in range(draw.randint(1, 9))} for _ in range(2))
        words = [bytes(draw.choices(b"abcd", k=draw.randint(1, 14))) for _ in range(30)]
        assert counts(W.Automaton(begins, continues), words) == [naive(w, begins, continues) for w in words]


def with_marker(word, begins, continues):
    """Greedy longest match; where no beginning token fits, the marker is one token and the word goes on."""
    n = naive(word, begins, continues)
    if any(word[:e] in begins for e in range(1, len(word) + 1)):
        return n
    rest = naive(word, continues, continues)
    return -1 if rest < 0 else 1 + rest


def test_bare_marker_begins_words_that_no_other_token_fits():
    draw = random.Random(3)
    for _ in range(300):
        begins, continues = ({bytes(draw.choices(b"abc", k=draw.randint(1, 5))) for _ in range(draw.randint(1, 9))} for _ in range(2))
        words = [bytes(draw.choices(b"abcd", k=draw.randint(1, 14))) for _ in range(30)]
        assert counts(W.Automaton(begins, continues, True), words) == [with_marker(w, begins, continues) for w in words]


def test_no_word_collapses_in_any_script(spark, tmp_path):
    from corpusloom.llm import queries
    byte = {c: b for b, c in byte_letters().items()}
    tokens = [t for t in json.load(open(PATH, encoding="utf-8"))["model"]["vocab"] if t != "<|endoftext|>"]
    begins = {bytes(byte[c] for c in t[1:]) for t in tokens if t[0] == "Ġ" and len(t) > 1}
    continues = {bytes(byte[c] for c in t) for t in tokens if t[0] != "Ġ"}
    texts = ["the house stands", "привет россия собака человек", "한국어 문장 가나다", "中文没有空格所以整段话都是一个词", "你好 不是 日本語", "\x00\x01"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op9_token_counts(spark, str(tmp_path)).collect():
        want = [with_marker(w, begins, continues) for w in texts[r.doc_id].encode().split()]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(want), sum(want), 0)


def test_documents_and_edges(spark, edge_docs, no_docs):
    machine = W.automaton(PATH)
    byte = {c: b for b, c in byte_letters().items()}
    tokens = [t for t in json.load(open(PATH, encoding="utf-8"))["model"]["vocab"] if t != "<|endoftext|>"]
    begins = {bytes(byte[c] for c in t[1:]) for t in tokens if t[0] == "Ġ" and len(t) > 1}
    continues = {bytes(byte[c] for c in t) for t in tokens if t[0] != "Ġ"}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40)
    docs = docs.union(edge_docs.select("doc_id", "text").where("doc_id <> 5 or doc_id is null"))
    for r in W.count_tokens(docs, machine).collect():
        n = [naive(w, begins, continues) for w in (r.text or "").encode().split()]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(n), sum(abs(x) for x in n), n.count(-1))
    assert W.count_tokens(edge_docs, machine).where("doc_id = 5").first().n_words == 40_000
    assert W.count_tokens(no_docs, machine).count() == 0
    long = spark.createDataFrame([("x" * 30_000,), ("é" * 3000,)], "text string")
    assert [r.n_words for r in W.count_tokens(long, machine).collect()] == [1, 1]
