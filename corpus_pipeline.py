"""Training-data pipeline over ``documents``: STAGES of (name, function), each calling one operator.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet into the
shared checkpoint folder and rereads it as the next stage's ``docs``. All but the last keep the columns
of ``documents``.

Null and empty texts have no letters and go in the first stage, as do documents in no learned language. Very long
texts are judged whole by every stage. Ties go to the smallest doc_id (near-duplicates) or to the operators' own
orders; repeated rows are near-duplicates of each other, so one of them stays. An empty table gives an empty result.
Extra columns keep their values, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, language_id, mixing, simhash, toxicity
from corpusloom.llm.arrow import held_out
from corpusloom.llm.queries import table, vocabulary_path
from corpusloom.session import materialize

#: A document is rejected if its best language has less than so many times the mean marginal of an even spread,
LEAST_OVER_EVEN = 1.2
#: or if less than this share of its words' 3-grams, beyond chance, occurred in training in any language.
LEAST_KNOWN = 0.5


def _apart(docs: DataFrame) -> DataFrame:
    """``docs`` with every column renamed, so that no extra column can clash with an operator's output."""
    return docs.select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in docs.columns])


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`in_{c}`").alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1. A document goes if it has no letters, if no language stands out (``LEAST_OVER_EVEN``), or if its words
    are in none of the learned languages (``LEAST_KNOWN``): another language or script, or garbled text."""
    model = language_id.train(docs.where(~held_out()))
    labelled = language_id.label_languages(_apart(docs), model, "in_text", evidence=True)
    least = min(1.0, LEAST_OVER_EVEN / max(1, len(model.labels)))
    return _back(labelled.where((F.col("lang_pred") != language_id.UND) & (F.col("score") >= least) & (F.col("known") >= LEAST_KNOWN)), docs)


def filter_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6. A document goes if it is predicted toxic (score 0.3 or more)."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return _back(toxicity.score_toxicity(_apart(docs), model, "in_text").where("predicted = 0"), docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7 with shingles of 3 words and at most 2 bits. The smallest doc_id of each group stays."""
    return _back(simhash.keep_one(_apart(docs), "in_doc_id", "in_text", shingle=3, max_distance=2), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10. Each document stays as often as the mix takes it: not at all, once, or up to three times."""
    return _back(mixing.repeat_taken(_apart(docs), "in_doc_id", "in_text", "in_source"), docs)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8. One row per document of the mix: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coded = bpe.round_trip(_apart(docs).select("in_doc_id", "in_text"), vocabulary_path("byte_bpe_50k.json"), "in_text")
    return coded.select(F.col("in_doc_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("toxicity", filter_toxicity),
    ("simhash_near_dedup", remove_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode_and_decode),
]

#: Models, Hamming links and byte-level merges are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
