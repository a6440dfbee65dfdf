"""Derive the pair table and the evaluation tables from the driver's read-only tables.

Every table here is computed by Spark from ``documents`` / ``embeddings``, so its size grows with
theirs. The recipe (line alignment, similarity rule, signal injection by ``pair_id % 16``) is the
fixture definition; the same recipe is written in SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.ordinal import with_running_total
from ..session import bucket_count

#: Lines of the shorter language are copied to the pairs they are in, up to so many pairs a line.
MAX_COPIES = 1000
NBSP = " "


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def document_lines(documents: DataFrame) -> DataFrame:
    """English and French documents with ``lines``, their non-empty ``\\n``-separated lines in order."""
    return (documents.where(F.col("lang").isin("en", "fr") & F.col("text").isNotNull())
            .select("doc_id", "lang", F.filter(F.split(F.col("text"), "\n"), lambda x: x != "").alias("lines")))


def _inject_en(en: Column, m: Column) -> Column:
    return (F.when(m == 0, F.concat(en, F.lit(" 12")))
             .when(m == 1, F.concat(en, F.lit(" (3)")))
             .when(m == 2, F.concat(en, F.lit(" see Figure 4 here")))
             .when(m == 4, F.concat(en, F.lit(" in 1998 only")))
             .when(m == 5, F.concat(en, F.lit(" it may")))
             .when(m == 11, F.concat(en, F.lit(" x y z")))
             .otherwise(en))


def _inject_fr(fr: Column, m: Column) -> Column:
    return (F.when(m == 3, F.concat(fr, F.lit("!!")))
             .when(m == 6, F.concat(F.lit("L "), fr))
             .when(m == 7, F.concat(fr, F.lit(" a l D eau")))
             .when(m == 8, T.strip_accents(fr))
             .when(m == 9, F.concat(fr, F.lit(" Tableau" + NBSP + "5")))
             .when(m == 10, F.concat(fr, F.lit(" l’eau")))
             .when(m == 12, F.concat(fr, F.lit(", a; b, c; d")))
             .when(m == 13, F.concat(fr, F.lit(" FÉVRIER")))
             .otherwise(fr))


def _inject_odd_fr(fr: Column, k: Column) -> Column:
    """Rows that real corpora have: a missing side, an empty one, blanks around a text, a text over the token limit."""
    return (F.when(k == 29, F.lit(None).cast("string"))
             .when(k == 43, F.lit(""))
             .when(k == 59, F.concat(F.lit("  "), fr, F.lit(" \t")))
             .when(k == 83, F.concat(fr, F.repeat(F.lit(" mot"), 600)))
             .otherwise(fr))


def similarity_rule(pair_id: Column) -> Column:
    return (F.lit(70) + (pair_id * F.lit(37)) % F.lit(31)).cast("double") / F.lit(100).cast("double")


def derive_pairs(spark: SparkSession, sf_dir: str, bucketed: bool = False) -> DataFrame:
    """(pair_id, fr, en, similarity): every line of the language with more lines, in order; the line it is
    paired with is the other language's line of that number modulo its number of lines.

    Lines are numbered by a running total of the documents' line counts (a table without texts) plus the
    line's place in its document, so no text is sorted for it.

    Lines meet on the shorter language's number, which moves each of them once. ``bucketed`` is for a table bucketed by
    ``pair_id``: lines meet on ``pair_id`` in ``bucket_count`` partitions, so that pairs are not shuffled again."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    docs = document_lines(documents)
    counts = docs.select("doc_id", "lang", F.size("lines").cast("long").alias("n")).where("n > 0")
    starts = with_running_total(counts, ["doc_id"], "n", "start", groups=["lang"])
    # the side without texts is hashed: the other needs no sort
    lines = docs.join(starts.select("doc_id", "lang", "start").hint("shuffle_hash"), ["doc_id", "lang"]) \
                .select("lang", "start", F.posexplode("lines").alias("place", "line")) \
                .select("lang", (F.col("start") + F.col("place")).alias("number"), "line")
    # a doc_id that comes twice has each text's lines at each text's start: numbers may go beyond the number of lines
    by_doc = starts.groupBy("lang", "doc_id").agg(F.sum("n").alias("n"), (F.max("start") + F.max("n")).alias("end"))
    found = by_doc.groupBy("lang").agg(F.sum("n").alias("n"), F.max("end").alias("end")).collect()
    n = {r["lang"]: r["n"] for r in found}
    longer, shorter = ("en", "fr") if n.get("en", 0) >= n.get("fr", 0) else ("fr", "en")
    end, n_shorter = max([r["end"] for r in found if r["lang"] == longer], default=0), n.get(shorter) or 1
    a = lines.where(F.col("lang") == longer).select(F.col("number").alias("pair_id"), F.col("line").alias(longer))
    b = lines.where(F.col("lang") == shorter).select("number", F.col("line").alias(shorter))
    if bucketed and end <= MAX_COPIES * n_shorter:
        copies = F.sequence(F.col("number"), F.lit(end - 1), F.lit(n_shorter))
        b = b.where(F.col("number") < n_shorter).select(F.explode(copies).alias("pair_id"), shorter)
        buckets = bucket_count(a.join(b, "pair_id"))
        pairs = a.repartition(buckets, "pair_id").join(b.repartition(buckets, "pair_id"), "pair_id")
    else:
        # a short language's line meets at most ceil(longer / shorter) lines: no hot key
        pairs = a.withColumn("number", F.col("pair_id") % F.lit(n_shorter)).join(b, "number")
    return inject(pairs.select("pair_id", "fr", "en"))


def inject(pairs: DataFrame) -> DataFrame:
    m, k = F.col("pair_id") % F.lit(16), F.col("pair_id") % F.lit(97)
    return pairs.select("pair_id", _inject_odd_fr(_inject_fr(F.col("fr"), m), k).alias("fr"), _inject_en(F.col("en"), m).alias("en"),
                        F.when(k != 13, similarity_rule(F.col("pair_id"))).alias("similarity"))


def derive_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in French lexicon: distinct lower-case ASCII tokens of French documents of even length."""
    docs = read_table(spark, sf_dir, "documents").where(F.col("lang") == "fr").select("text")
    tokens = docs.select(F.explode_outer(T.whitespace_tokens("text")).alias("word"))
    return (tokens.where(F.col("word").rlike("^[a-z]+$") & (F.length("word") % 2 == 0))
                  .distinct())
