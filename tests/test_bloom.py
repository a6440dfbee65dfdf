from pyspark.sql import functions as F

from corpusloom.operators import accent as A
from corpusloom.operators import bloom as B


def test_no_word_of_the_list_is_lost_and_few_others_pass(spark):
    words = spark.range(20_000).select(F.concat(F.lit("word"), F.col("id").cast("string")).alias("token"))
    others = spark.range(50_000).select(F.concat(F.lit("other"), F.col("id").cast("string")).alias("token"))
    made = B.build(words)
    assert made[1] > 1  # several bitmaps
    assert B.keep_candidates(words, made).count() == 20_000
    assert B.keep_candidates(others, made).count() < 0.02 * 50_000
    share = B.false_positive_share(words.union(others), words)
    assert 0 < share < 0.02
    nulls = spark.createDataFrame([(None,), ("word7",), ("",)], "token string")
    assert [r.token for r in B.keep_candidates(nulls, made).collect()] == ["word7"]
    assert B.keep_candidates(nulls, made, always=F.col("token").isNull()).count() == 2
    nothing = B.build(words.limit(0))
    assert B.keep_candidates(nulls, nothing).count() == 0


def test_hits_are_equal_at_any_list_size(spark):
    rows = spark.createDataFrame([(1, "le chat le chien"), (2, None), (3, ""), (4, "rien ici"), (5, "chat " * 50), (5, "chat " * 50), (6, " le ")], "pair_id long, fr string")
    lists = {"a": spark.createDataFrame([("le",), ("chat",), ("x",)], "word string"), "b": spark.createDataFrame([("chien",)], "word string")}
    plain = sorted(map(str, A.word_lists_hits(rows, lists, "fr", broadcast_words=True).collect()))
    sieved = A.word_lists_hits(rows, lists, "fr", broadcast_words=False)
    assert sorted(map(str, sieved.collect())) == plain


def test_only_candidates_are_shuffled(spark):
    text = spark.range(200).select(F.col("id").alias("pair_id"), F.concat_ws(" ", F.sequence(F.col("id") * 50, F.col("id") * 50 + 49).cast("array<string>")).alias("fr"))
    words = spark.range(0, 10_000, 500).select(F.col("id").cast("string").alias("word"))
    tokens = text.select(F.explode(F.split("fr", " ")).alias("token"))
    left = B.keep_candidates(tokens, B.build(words.select(F.col("word").alias("token"))))
    assert 20 <= left.count() < 200  # of 10,000 tokens
    hits = A.word_list_hits(text, words, "fr", "n", broadcast_words=False)
    assert hits.agg(F.sum("n")).first()[0] == 20
