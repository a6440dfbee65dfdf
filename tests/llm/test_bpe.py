import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a\n\n b  ", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>", "don't we'll I'M it's", "a" * 5000, "é" * 300,
       "日本語テキスト 😀😀", "\x00\x01\x7f", "  \t\n  ", "ab" * 40, "x" * 64, "x" * 65, " " * 1000 + "y", "0123456789" * 50, "   x", "²½Ⅷ १२", " a b",
       "aaaaaaaaa", "the the the", "<|endoftext", "éé", "thethethethe" * 30]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as f:
        return B.vocabulary(f.read())


def test_equals_the_tokenizers_library(vocabulary, library, spark):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text, ids in zip(texts, vocabulary.encode_all(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want, text[:50]
        assert vocabulary.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_one_tree_and_many_trees_agree(vocabulary):
    pieces = [p.encode() for p in (" something", "internationalization", "x" * 63, "abcabcabc" * 7, "é" * 20, "q")]
    for p in pieces:
        assert vocabulary._merge_alone(p) == vocabulary._merge([p])[0]


def test_a_long_piece_takes_logarithmic_updates(vocabulary, library):
    text = "ab1"[:2] * 100_000
    assert vocabulary.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_table_of_known_pieces_is_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(B, "KNOWN_PIECES", 10)
    first = vocabulary.encode("one two three four five six seven eight nine ten eleven twelve")
    assert first == vocabulary.encode("one two three four five six seven eight nine ten eleven twelve")


def test_frames(spark, edge_docs, no_docs, library):
    coded = B.decode(B.encode(edge_docs, PATH), PATH)
    for r in coded.collect():
        assert r.decoded == (r.text or "") and r.ids == library.encode(r.text or "", add_special_tokens=False).ids
    trip = B.round_trip(edge_docs, PATH)
    assert trip.count() == edge_docs.count() and trip.where("text is null").first().n_tokens == 0
    assert B.round_trip(no_docs, PATH).count() == 0
    odd = spark.createDataFrame([([],), (None,), ([50256, -1, 10**6, None, 464],)], "ids array<int>")
    assert [r.decoded for r in B.decode(odd, PATH).collect()] == ["", "", "<|endoftext|>The"]
    broken = spark.createDataFrame([([library.encode("é", add_special_tokens=False).ids[0], 127],)], "ids array<int>")
    assert B.decode(broken, PATH).first().decoded == library.decode([library.encode("é", add_special_tokens=False).ids[0], 127], skip_special_tokens=False)
