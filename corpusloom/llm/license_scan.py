"""License notices by diagonal voting, in DataFrame operations only.

1. Every document and every template is cut into words; all rolling k-grams (k = 2) are hashed.
2. One equi-join on the hash maps document positions to template positions. The join also compares the
   gram's words, so every vote is verified and a hash collision cannot cast one. The template side has
   one row per template position: its size is fixed by the template list, so it is broadcast.
3. A vote at document position p for template position t lies on diagonal p - t. Repeated votes count once.
4. Each vote opens a window that reaches as far as a span may: ``STRETCH`` times the template's length, or a base
   phrase's own length. Of the votes in it, those count whose diagonals are linked to the opening vote's by steps
   of at most ``SHIFT`` (words were inserted or left out; 0 for a base phrase). A bit mask of their template
   positions gives the coverage. As no window is longer than a span, votes nearby can't spoil a complete notice.
5. A base phrase stands where all its grams vote on one diagonal. A notice is verified if at least ``COVER`` of
   its grams vote, and if the grams that tell it from its relatives (``DECIDING``: product, nc/sa, version)
   are among them; it then adds its label. Of a notice's spans that begin within its length, the best-covered stays.

Texts are never shuffled: what leaves the scan is one row per vote. A window holds at most
as many votes as a span has words, times the gram's places in the template. Common grams meet as many template
positions as the list holds, so the join's output is linear in the words.

Edge cases: a null text is empty; a document without words or votes has zero counts, null positions,
empty label strings and score 0. Documents with the same id are told apart by a digest of their text;
repeated rows each get the row's result. A very long text is a row a gram: nothing of it is held together but its words.
An empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, SHIFT, COVER, STRETCH = 2, 3, 0.6, 1.5

#: Units of a window; far more than the square of any template's reach in words.
REACH = 1 << 20

#: Phrase and label of the base scan.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Opening words of common notices, and the labels that the method adds.
NOTICES = [
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("all rights reserved", "all-rights-reserved"),
]

#: For each notice, the grams that must vote besides the coverage; "a|b" asks for one of them. A
#: notice that isn't listed (a caller's own) is verified by its coverage alone.
DECIDING = {
    NOTICES[0][0]: ["gnu general", "version 3"],
    NOTICES[1][0]: ["gnu general", "public license"],
    NOTICES[2][0]: ["lesser general"],
    NOTICES[3][0]: ["affero general"],
    NOTICES[4][0]: ["apache license", "2 0"],
    NOTICES[5][0]: ["by nc", "nc 4", "4 0"],
    NOTICES[6][0]: ["by sa", "sa 4", "4 0"],
    NOTICES[7][0]: ["creative commons", "commons attribution", "attribution 4", "4 0"],
    NOTICES[8][0]: ["the mit|mit license"],
    NOTICES[9][0]: ["this software", "associated documentation"],
    NOTICES[10][0]: ["and binary|binary forms"],
    NOTICES[11][0]: ["mozilla public", "2 0"],
}


def words(text: Column) -> Column:
    """Words of the ASCII-lower-cased text: runs of digits, a-z and characters beyond ASCII. ``lower`` may
    also change letters beyond ASCII, which are word characters before and after."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lead = F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
    tail = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.slice(parts, lead + 1, F.size(parts) - lead - tail)


def _grams(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per rolling k-gram: position, hash and the gram's words (from a column ``words``)."""
    gram = lambda i: F.concat_ws(" ", *[F.get("words", i + j) for j in range(K)])
    places = F.when(F.size("words") >= K, F.sequence(F.lit(0), F.size("words") - K)).otherwise(F.array().cast("array<int>"))
    return df.select(*keys, F.posexplode(F.transform(places, gram)).alias("pos", "gram")) \
             .withColumn("h", F.xxhash64("gram"))


def _deciding_masks(phrase: str) -> list[int]:
    """For each entry of ``DECIDING``, a bit mask of the template positions of which one must vote."""
    parts = phrase.split()
    grams = [" ".join(parts[i:i + K]) for i in range(len(parts) - K + 1)]
    return [sum(1 << i for i, g in enumerate(grams) if g in entry.split("|")) for entry in DECIDING.get(phrase, [])]


def template_positions(df: DataFrame, base: list[tuple[str, str]], notices: list[tuple[str, str]]) -> DataFrame:
    """One row per gram of every template, with the template's number, label, length in grams and deciding grams."""
    spark = df.sparkSession
    rows = [(i, label, i < len(base), phrase, _deciding_masks(phrase)) for i, (phrase, label) in enumerate([*base, *notices])]
    if any(not 1 <= len(r[3].split()) - K + 1 <= 62 for r in rows):
        raise ValueError("a template needs 2 to 63 words")
    t = spark.createDataFrame(rows, "template int, label string, is_base boolean, phrase string, deciding array<long>") \
             .withColumn("words", words(F.col("phrase"))).withColumn("n_grams", F.size("words") - K + 1)
    return _grams(t, ["template", "label", "is_base", "n_grams", "deciding"]).withColumnRenamed("pos", "tpos")


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          base: list[tuple[str, str]] = BASE, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """Verified spans: id, digest of the text, label, is_base, first word (from 0), words spanned, coverage."""
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), words(F.col(text_col)).alias("words"))
    templates = template_positions(df, base, notices)
    key = ["id", "digest", "template"]
    about = [F.first(c).alias(c) for c in ("label", "is_base", "n_grams", "deciding")]
    votes = _grams(docs, ["id", "digest"]).join(F.broadcast(templates), ["h", "gram"]) \
        .groupBy(*key, "pos", "tpos").agg(*about)
    # positions in units that make the same reach in words the same for every template
    units = lambda reach: F.col("pos").cast("long") * F.floor(F.lit(REACH) / F.greatest(reach, F.lit(0.5))).cast("long")
    place = units(F.when(F.col("is_base"), F.col("n_grams") - 1).otherwise(F.floor(STRETCH * (F.col("n_grams") + K - 1)) - K))
    ahead = Window.partitionBy(*key).orderBy("place").rangeBetween(0, REACH)
    opened = votes.withColumn("place", place) \
        .withColumn("union", F.bit_or(F.expr("shiftleft(1L, tpos)")).over(ahead)) \
        .withColumn("near", F.collect_list(F.struct((F.col("pos") - F.col("tpos")).alias("diagonal"), "pos", "tpos")).over(ahead)) \
        .where(_verified(F.col("union")))
    low, high = _linked(F.col("pos") - F.col("tpos"), F.when(F.col("is_base"), 0).otherwise(SHIFT))
    linked = opened.withColumn("chain", F.struct(low.alias("low"), high.alias("high"))) \
        .withColumn("near", F.filter("near", lambda v: v["diagonal"].between(F.col("chain.low"), F.col("chain.high")))) \
        .withColumn("mask", F.aggregate("near", F.lit(0).cast("long"), lambda m, v: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), v["tpos"])))) \
        .where(_verified(F.col("mask"))) \
        .withColumn("n_span", F.array_max(F.transform("near", lambda v: v["pos"])) - F.col("pos") + K) \
        .withColumn("rank", F.struct(F.bit_count("mask").alias("n"), (-F.col("n_span")).alias("short"), (-F.col("pos")).alias("early"), (-F.col("tpos")).alias("t")))
    meets = Window.partitionBy(*key).orderBy("place").rangeBetween(-REACH, REACH)
    best = F.col("is_base") | (F.col("rank") == F.max("rank").over(meets))
    return linked.withColumn("place", units(F.col("n_grams") + K - 2)).withColumn("best", best).where("best").select(
        "id", "digest", "label", "is_base", F.col("pos").cast("long").alias("first_word"),
        F.col("n_span").cast("long").alias("n_span"), (F.bit_count("mask") / F.col("n_grams")).alias("cover"))


def _verified(mask: Column) -> Column:
    """Whether the template positions in ``mask`` are enough."""
    cover = F.bit_count(mask) / F.col("n_grams")
    decided = F.forall("deciding", lambda one_of: mask.bitwiseAND(one_of) != 0)
    return F.when(F.col("is_base"), cover == 1.0).otherwise((cover >= COVER) & decided)


def _linked(own: Column, shift: Column) -> tuple[Column, Column]:
    """Smallest and largest diagonal of the chain that holds diagonal ``own``, among those of ``near``."""
    diagonals = F.array_sort(F.array_distinct(F.transform("near", lambda v: v["diagonal"])))
    up = F.filter(diagonals, lambda d: d >= own)
    down = F.reverse(F.filter(diagonals, lambda d: d <= own))
    end = lambda ds: F.aggregate(ds, own, lambda last, d: F.when(F.abs(d - last) <= shift, d).otherwise(last))
    return end(down), end(up)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         base: list[tuple[str, str]] = BASE, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row per row of ``df``: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans(df, id_col, text_col, base, notices).groupBy("id", "digest").agg(
        F.count_if("is_base").alias("n_base"),
        F.min(F.when(F.col("is_base"), F.col("first_word"))).alias("first_word"),
        F.max(F.when(F.col("is_base"), F.col("first_word"))).alias("last_word"),
        joined(F.when(F.col("is_base"), F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"), F.max("cover").alias("score"))
    n_words = F.regexp_count(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), n_words.cast("long").alias("n_words"))
    d, f = docs.alias("d"), found.alias("f")
    return d.join(f, F.col("d.id").eqNullSafe(F.col("f.id")) & (F.col("d.digest") == F.col("f.digest")), "left").select(
        F.col("d.id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
