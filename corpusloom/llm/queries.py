"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, bsi_topk, debruijn, language_id, license_scan, mixing, pair_bitmaps, prefix_trie, simhash, toxicity, url_filter, winnowing, wordpiece
from .arrow import held_out
from .oracles import ORACLE  # noqa: F401  registered beside QUERIES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary_path(name: str) -> str:
    """Where the installed public tokenizers keep a vocabulary file (read on the driver only)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(~held_out()))
    return language_id.label_languages(docs.drop("lang"), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_edits(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_bsi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bsi_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64)
    return found.withColumnRenamed("id", "vec_id")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rules(spark))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", F.col("predicted").cast("int").alias("predicted"), "n_hits")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_distance=2)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, vocabulary_path("byte_bpe_50k.json")).drop("text")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    machine = wordpiece.automaton(vocabulary_path("byte_bpe_50k.json"), bare_marker=True)
    return wordpiece.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), machine).drop("text")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op11_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pair_bitmaps.align(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"),
                              vocabulary_path("piece_bpe_32k.model"), pattern=public_tokenizers.PATTERN)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op13_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_winnowing": op3_winnowing,
    "op4_bsi_topk": op4_bsi_topk,
    "op5_url_filter": op5_url_filter,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_bpe": op8_bpe,
    "op9_token_counts": op9_token_counts,
    "op10_mixing": op10_mixing,
    "op11_pair_bitmaps": op11_pair_bitmaps,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_debruijn": op13_debruijn,
}
