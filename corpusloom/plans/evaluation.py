"""Entries 2 and 3 of the original project: training-input preparation and translator evaluation,
over tables Spark derives from the curated pairs and the driver's ``embeddings``.

Fixture rules (also written in SQL in ``plans.oracle_eval``); the tables are materialised stages
of the session's ``Curation``, shared by every query that reads them:
* corpus: the bidirectional expansion of the pairs, record_id = 2 * pair_id + direction;
* comparison: one English-to-French sample per pair x 4 translators; vectors are rows of
  ``embeddings`` picked by pair_id % N, (pair_id * 7 + 1) % N, (pair_id * 13 + k) % N;
  base translators return the reference text, fine-tuned ones its cleaned form;
* survey: column per translator k = element (pair_id * (k + 2)) % 7 of the category list;
* sweep: each registry model's grid; losses from the characters and records of the model's split and the
  grid indexes; one missing loss per model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import prep as P
from ..operators import sampling as S
from ..operators import subword as SW
from ..session import Scope
from .curation import Curation

COMPARED = ["opus_mt_base", "opus_mt_finetuned", "m2m100_418m_base", "m2m100_418m_finetuned"]
# fixed values: survey answer categories in rule order; None is an unanswered question
SURVEY_CATEGORIES = ["bad", "worse", "good", "better", "best", None, "other"]


def corpus(c: Curation) -> DataFrame:
    return P.bidirectional(c.pairs())


def split_corpus(c: Curation) -> DataFrame:
    return S.train_eval_split(corpus(c), "record_id")


def embeddings(c: Curation) -> DataFrame:
    from .fixtures import read_table
    return read_table(c.spark, c.sf_dir, "embeddings").select("vec_id", "embedding")


def comparison(c: Curation) -> DataFrame:
    """Comparison rows: the written cosines joined to the pair's texts."""
    # cleaned under the join: once per pair, not once per row
    pairs = c.pairs().select("pair_id", F.col("en").alias("source"), F.col("fr").alias("target"),
                             T.clean_common_patterns("fr").alias("_cleaned"))
    rows = c.stage("comparison", lambda: _comparison(c), "pair_id").join(pairs, "pair_id")
    translated = F.when(F.col("translator_name").endswith("_finetuned"), F.col("_cleaned")).otherwise(F.col("target"))
    return rows.select("pair_id", "source", "target", F.lit("en").alias("source_lang"), F.lit("fr").alias("other_lang"),
                       "translator_name", translated.alias("translated_text"), *SCORES)


SCORES = ["cosine_similarity_original_translation", "cosine_similarity_vs_source", "cosine_similarity_vs_target"]


def scores(c: Curation) -> DataFrame:
    """pair_id, translator_name and the cosines."""
    return c.stage("comparison", lambda: _comparison(c), "pair_id")


def _comparison(c: Curation) -> DataFrame:
    emb = embeddings(c)
    n_vec = F.lit(emb.count())
    # each vector's norm once per embedding row; each cosine is then a single dot product
    # float32 as stored (half the bytes in joins); dot products widen every element to double,
    # which is exact, so results equal a cast-first computation
    vec = emb.select("vec_id", F.col("embedding").alias("vec")).withColumn("norm", T.norm("vec"))
    ids = ["src_vec_id", "tgt_vec_id", "trans_vec_ids"]
    samples = c.pairs().select(
        "pair_id", (F.col("pair_id") % n_vec).alias("src_vec_id"), ((F.col("pair_id") * 7 + 1) % n_vec).alias("tgt_vec_id"),
        F.array(*[(F.col("pair_id") * 13 + k) % n_vec for k in range(len(COMPARED))]).alias("trans_vec_ids"))
    # samples that name the same vectors have the same cosines: vectors meet once per distinct choice of ids, and
    # samples are joined to the numbers. Source and target are compared before the fan-out
    chosen = samples.select(*ids).distinct()
    per_choice = (chosen.join(vec.toDF("src_vec_id", "src_vec", "src_norm"), "src_vec_id")
                        .join(vec.toDF("tgt_vec_id", "tgt_vec", "tgt_norm"), "tgt_vec_id")
                        .withColumn("cosine_similarity_original_translation",
                                    T.cosine_from_norms("src_vec", "tgt_vec", "src_norm", "tgt_norm")))
    names = F.array(*[F.lit(name) for name in COMPARED])
    rows = per_choice.select("*", F.posexplode("trans_vec_ids").alias("translator_index", "trans_vec_id"))
    joined = rows.join(vec.toDF("trans_vec_id", "trans_vec", "trans_norm"), "trans_vec_id")
    compared = joined.select(
        *ids, F.get(names, F.col("translator_index")).alias("translator_name"), "cosine_similarity_original_translation",
        T.cosine_from_norms("src_vec", "trans_vec", "src_norm", "trans_norm").alias("cosine_similarity_vs_source"),
        T.cosine_from_norms("tgt_vec", "trans_vec", "tgt_norm", "trans_norm").alias("cosine_similarity_vs_target"))
    return samples.join(compared, ids).select("pair_id", "translator_name", *SCORES)


def survey(c: Curation) -> DataFrame:
    cats = F.array(*[F.lit(x).cast("string") for x in SURVEY_CATEGORIES])
    cols = {name: F.element_at(cats, ((F.col("pair_id") * (k + 2)) % 7 + 1).cast("int"))
            for k, name in enumerate(COMPARED)}
    return c.pairs().select(
        F.col("fr").alias("source"),
        F.when(F.col("pair_id") % 2 == 0, F.lit("train")).otherwise(F.lit("test")).alias("corpus_type"),
        *[v.alias(k) for k, v in cols.items()])


def sweep(c: Curation) -> DataFrame:
    return c.stage("sweep", lambda: _sweep(c))


def _sweep(c: Curation) -> DataFrame:
    reg = P.registry(c.spark)
    grid = (reg.select("model", F.posexplode("lr_grid").alias("lr_index", "lr"), "r_grid", "dropout_grid")
               .select("model", "lr_index", "lr", F.posexplode("r_grid").alias("r_index", "lora_r"), "dropout_grid")
               .select("model", "lr_index", "lr", "r_index", "lora_r",
                       F.posexplode("dropout_grid").alias("d_index", "lora_dropout")))
    grid = grid.withColumn("lora_alpha", F.floor(F.lit(2.0) * F.col("lora_r")).cast("int"))
    sizes = P.train_sizes(split_corpus(c), reg)
    # losses that the data decide: characters and records of the model's split, weighed by the trial's place
    def loss(split):
        mixed = F.col(f"{split}_chars") * (F.col("lr_index") + 1) + F.col(f"{split}_rows") * F.col("lora_r")
        return (mixed % 1000).cast("double") / F.lit(1000.0)
    eval_loss = F.when((F.col("lr_index") == 0) & (F.col("r_index") == 0), F.lit(None).cast("double")).otherwise(loss("eval"))
    train_loss = loss("train")
    trial_dir = F.concat(F.col("model"), F.lit("_auto/lr"), F.col("lr_index").cast("string"),
                         F.lit("_r"), F.col("lora_r").cast("string"), F.lit("_a"),
                         F.col("lora_alpha").cast("string"), F.lit("_d"), F.col("d_index").cast("string"))
    return grid.join(F.broadcast(sizes), "model").select(
        "model", trial_dir.alias("trial_dir"), "lr", "lora_r", "lora_alpha", "lora_dropout",
        *P.capped_samples(),
        train_loss.alias("final_train_loss"), eval_loss.alias("final_eval_loss"))


def prompts_and_outputs(c: Curation) -> DataFrame:
    """Records with their instruction prompt and a generated text (with or without the marker)."""
    recs = corpus(c).withColumn("prompt", T.build_prompt("source", "source_lang"))
    generated = F.when(F.col("record_id") % 2 == 0,
                       F.concat(F.col("prompt"), F.lit(" "), F.col("target"), F.lit("\nextra line")))\
                 .otherwise(F.concat(F.lit("Output: "), F.col("target"), F.lit("\nnoise")))
    return recs.withColumn("generated", generated)


def tagged_records(c: Curation) -> DataFrame:
    k = (F.col("pair_id") % 7 + 1).cast("string")
    tagged = (F.when(F.col("record_id") % 97 == 5, F.concat(F.col("source"), F.repeat(F.concat(F.lit(" <KE"), k, F.lit(">")), 200)))
               .when(F.col("record_id") % 3 == 0,
                     F.concat(F.lit("<KE"), k, F.lit(">"), F.col("source"), F.lit("</KE"), k, F.lit(">")))
               .when(F.col("record_id") % 3 == 1,
                     F.concat(F.col("source"), F.lit(" <KE"), k, F.lit("> <KE"), k, F.lit(">")))
               .otherwise(F.col("source")))
    return corpus(c).select("record_id", tagged.alias("text"))


def vocabulary(c: Curation) -> DataFrame:
    return c.stage("word_vocabulary", lambda: P.word_vocabulary(corpus(c)))


def tokens(c: Curation) -> DataFrame:
    """The tokenised records, not written: for a query that reads them once."""
    return P.tokenize_records(corpus(c), vocabulary(c), partition_keys=("pair_id",))


def written_tokens(c: Curation) -> DataFrame:
    """pair_id, record_id, input_ids and labels, for a query that reads them twice: bucketed by ``pair_id`` as the pair
    table is, whose tasks they never leave."""
    return c.stage("tokens", lambda: tokens(c).select(F.shiftright("record_id", 1).alias("pair_id"), "record_id", "input_ids", "labels"),
                   "pair_id", placed=True)


def subwords(c: Curation, size: int) -> SW.Subwords:
    """A subword vocabulary learned (once) from both sides of all pairs."""
    if size not in c.subword_models:
        side = lambda name: c.pairs().select(F.col(name).alias("text"))
        with Scope(c.spark):  # the model is all that is left of it
            c.subword_models[size] = SW.train(side("fr").union(side("en")), size)
    return c.subword_models[size]


def shuffled_split(c: Curation) -> DataFrame:
    """(record_id, split, position): only the ids travel through the distributed sort; consumers
    join the positions to whatever record columns they need."""
    return c.stage("shuffled_split",
                   lambda: S.seeded_shuffle(split_corpus(c).select("record_id", "split"), "record_id"))
