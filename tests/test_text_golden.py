"""Golden micro-rows for the row-local text operators, and parity with Python's own semantics."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom import constants as K
from corpusloom.functions import text as T
from corpusloom.functions.accents import strip_accents_py
from corpusloom.operators import gates as G

NBSP = " "


def one(spark, value, expr_fn, schema="x string"):
    df = spark.createDataFrame([(value,)], schema)
    return df.select(expr_fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("src,expected", [
    ("a l D x", "a l'D'x"),
    ("a D l x", "a D'l x"),
    ("L d x", "L'd x"),
    ("a l l x", "a l'l x"),
    ("l a", "l'a"),
])
def test_apostrophe_repair_is_sequential(spark, src, expected):
    assert one(spark, src, T.repair_apostrophes) == expected


@pytest.mark.parametrize("text,lang,expected", [
    ("Tableau" + NBSP + "3", "fr", True),
    ("stable 3", "en", True),
    ("voir Fig. 3\nsuite", "fr", False),
    ("see Fig. 12 and more", "en", True),
    ("nothing here", "en", False),
])
def test_figure_reference_flag(spark, text, lang, expected):
    assert one(spark, text, lambda c: T.figtext_flags(c, lang)["has_figure_references"]) is expected


@pytest.mark.parametrize("text,expected", [
    ("FÉVRIER", True), ("AOÛT 3", True), ("dismay", True), ("it may", True),
    ("é1999", False), ("1999é", False), ("in 1998 only", True), ("nothing", False),
])
def test_date_flag(spark, text, expected):
    assert one(spark, text, lambda c: T.has_date_refs(c)) is expected


def test_bounds_treat_missing_as_outside(spark):
    rows = [(1.0,), (2.0,), (float("nan"),), (None,), (float("inf"),)]
    df = spark.createDataFrame(rows, "v double")
    got = [r["o"] for r in df.select(G.outside(F.col("v"), 0.5, 1.5).alias("o")).collect()]
    assert got == [False, True, True, True, True]


def test_word_replacement_whole_words_case_sensitive(spark):
    df = spark.createDataFrame([("ete, l'ete eteint Ete ete-ete",)], "x string")
    m = F.create_map(F.lit("ete"), F.lit("été"))
    assert df.select(T.replace_words("x", m).alias("y")).first()["y"] == "été, l'été eteint Ete été-été"


def test_strip_accents_matches_unicodedata(spark):
    assert one(spark, "été cœur naïve Ça", T.strip_accents) == "ete cœur naive Ca"
    sample = "àâäçéèêëîïôöùûüÿñÁÉÍÓÚ ŁłØøœŒßĳ é"
    assert one(spark, sample, T.strip_accents) == strip_accents_py(sample)


def py_one_char(s, allow):
    return sum(len(w) == 1 for w in s.split() if w not in allow)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=list("aAlLdDxyz éÀà\t\x1c\x1f") + [NBSP, "\n"], max_size=30))
def test_one_char_words_equals_python(spark, s):
    assert one(spark, s, lambda c: T.one_char_words(c, K.ONE_CHAR_ALLOW_FR)) == py_one_char(s, K.ONE_CHAR_ALLOW_FR)


def py_figtext(text, lang):
    return {
        "has_trailing_numbers": bool(re.search(K.TRAILING_NUMBER_PATTERN, text)),
        "has_parenthetical_numbers": bool(re.search(K.PARENTHETICAL_NUMBER_PATTERN, text)),
        "has_figure_references": bool(re.search(K.FIGURE_REFERENCE_PATTERN[lang], text, flags=re.IGNORECASE)),
        "has_repeated_punctuation": bool(re.search(K.REPEATED_PUNCTUATION_PATTERN, text)),
    }


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=list("Figure TablTAB.()!?12 x") + [NBSP, "\n", " "], max_size=25),
       st.sampled_from(["en", "fr"]))
def test_figtext_equals_python(spark, text, lang):
    df = spark.createDataFrame([(text,)], "x string")
    flags = T.figtext_flags("x", lang)
    got = df.select(*[flags[k].alias(k) for k in flags]).first().asDict()
    want = py_figtext(text, lang)
    assert {k: got[k] for k in want} == want


def test_clean_common_patterns(spark):
    cases = {
        "12. Figure 3 shows DFO 2004a data – see ‘this’": "shows data - see 'this'",
        "  (Table 2) text  ": "text",
        "Fig. 3 keeps the period": "Fig. 3 keeps the period",
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    got = {r["x"]: r["y"] for r in df.select("x", T.clean_common_patterns("x").alias("y")).collect()}
    assert got == cases


def test_extract_response(spark):
    df = spark.createDataFrame([("[INST] p [/INST]  answer one\nmore", "[INST] p [/INST]"),
                                ("PROMPT the text\nsecond", "PROMPT")], "g string, p string")
    got = [r["r"] for r in df.select(T.extract_response("g", "p").alias("r")).collect()]
    assert got == ["answer one", "the text"]


def test_cosine_similarity(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert df.select(T.cosine_similarity("a", "b").alias("c")).first()["c"] == round(2 ** -0.5, 6)


# an invented OCR-style junk line: mostly stray single characters
JUNK_FR = "3 x - q o K U .- b t w Y O C r ' W I 7 I 2 N 9 N 4 N I N C U ) 5 N 8 8 N 6 M 2 N N I O M U ) b"


def _gate_rows(spark, rows):
    from corpusloom.plans.curation import feature_columns
    pairs = spark.createDataFrame(rows, "pair_id long, fr string, en string, similarity double")
    feats = (feature_columns(pairs).withColumn("fr", F.col("fr_apos"))
             .withColumn("potential_fr_accent_issues", F.lit(0).cast("long")))
    return {r["pair_id"]: r for r in G.add_gate_columns(feats).collect()}


def test_junk_ocr_string_is_excluded(spark):
    got = _gate_rows(spark, [(1, JUNK_FR, "Junk text from a scanned table", 0.93),
                             (2, "Le taux est faible.", "The rate is low.", 0.93)])
    assert got[1]["exclude"] and got[1]["exclude_one_char_words_fr"]
    assert not got[2]["exclude"]


def test_truncated_translation_has_a_low_length_ratio(spark):
    fr = ("Les prises de morue ont diminué dans le golfe, tandis que les prises de plie et de flétan "
          "ont augmenté au cours des dix dernières années")
    en = "Cod catches decreased in the gulf"
    df = spark.createDataFrame([(fr, en)], "fr string, en string")
    r = df.select(T.len_ratio("en", "fr").alias("rev"), T.len_ratio("fr", "en").alias("fwd")).first()
    assert r["rev"] < 0.5 < 2 < r["fwd"]
