import pytest

LONG = "lorem ipsum " * 20_000


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, a repeated id with another
    text, and extra columns whose names operators use for their own."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog.", "en", "a", 44),
        (2, None, "en", "a", None),
        (3, "", None, "b", 0),
        (4, " \t\n ", "de", None, 4),
        (5, LONG, "en", "b", len(LONG)),
        (6, "same text here, the same text", "en", "a", 29),
        (6, "same text here, the same text", "en", "a", 29),
        (6, "other text under the same id", "en", "a", 28),
        (7, "same text here, the same text", "fr", "c", 29),
        (None, "a row without an id", "en", "c", 19),
        (8, "1234 5678 !!! \x00\x01", None, None, None),
        (9, "Größe, naïve — 日本語 😀 <|endoftext|> end", "de", "b", 40),
    ]
    extra = [(*r, 0.5, "x", "d", 1, 2, "k") for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, "
                                        "score double, Lang_Pred string, digest string, id int, part int, rank string")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
