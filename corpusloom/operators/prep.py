"""Model-input preparation (ops 4, 50-52, 72-74): corpus records, sizes, tokenising, batching.

The default tokenizer is a frequency-ranked word vocabulary built by Spark from the corpus itself
(ids: 0 pad, 1 end-of-sequence, 2 unknown, 3/4 the English/French language tokens, words from 5).
A caller's own tokenizer plugs in through ``operators.plugins.tokenize_with``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from .. import constants as K
from ..functions import text as T
from ..session import ship_package
from .ordinal import with_ordinal
from .sizing import is_small

PAD_ID, EOS_ID, UNK_ID = 0, 1, 2
LANG_IDS = {"en": 3, "fr": 4}
FIRST_WORD_ID = 5
# vocabularies up to this many words are broadcast for the id lookup; larger ones shuffle-join
VOCAB_BROADCAST_MAX_ROWS = 2_000_000


def bidirectional(pairs: DataFrame) -> DataFrame:
    """Op 4: each pair becomes an en->fr record, then a fr->en record; record_id = 2*pair_id + direction."""
    recs = F.array(
        F.struct(F.lit(0).alias("direction"), F.col("en").alias("source"), F.col("fr").alias("target"),
                 F.lit("en").alias("source_lang")),
        F.struct(F.lit(1).alias("direction"), F.col("fr").alias("source"), F.col("en").alias("target"),
                 F.lit("fr").alias("source_lang")),
    )
    out = pairs.select("pair_id", F.inline(recs))
    return out.withColumn("record_id", F.col("pair_id") * 2 + F.col("direction"))


REGISTRY_SCHEMA = Ty.StructType([
    Ty.StructField("model", Ty.StringType(), False),
    Ty.StructField("model_id", Ty.StringType(), False),
    Ty.StructField("language_map", Ty.MapType(Ty.StringType(), Ty.StringType()), False),
    Ty.StructField("restrict_source_language", Ty.StringType(), True),
    Ty.StructField("batch_size", Ty.IntegerType(), False),
    Ty.StructField("grad_accum", Ty.IntegerType(), False),
    Ty.StructField("lr_grid", Ty.ArrayType(Ty.DoubleType()), False),
    Ty.StructField("r_grid", Ty.ArrayType(Ty.IntegerType()), False),
    Ty.StructField("dropout_grid", Ty.ArrayType(Ty.DoubleType()), False),
])


def registry(spark: SparkSession) -> DataFrame:
    """The model registry: a configuration dimension of a few rows."""
    rows = [tuple(m[f.name] for f in REGISTRY_SCHEMA.fields) for m in K.MODEL_REGISTRY]
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def registry_entries(models=K.MODEL_REGISTRY) -> Column:
    """The registry as one literal array of structs. Fanning a record out to every model is then a
    generate (``explode``) inside the record's own task, not a join."""
    def entry(m):
        lang_map = F.create_map(*[F.lit(x) for kv in m["language_map"].items() for x in kv])
        return F.struct(F.lit(m["model"]).alias("model"),
                        F.lit(m["restrict_source_language"]).cast("string").alias("restrict_source_language"),
                        lang_map.alias("language_map"))
    return F.array(*[entry(m) for m in models])


def route_language(records: DataFrame, models=K.MODEL_REGISTRY) -> DataFrame:
    """Op 36: target language = the other of en/fr; codes through the model's language map."""
    target = F.when(F.col("source_lang") == "fr", F.lit("en")).otherwise(F.lit("fr"))
    fanned = records.select("record_id", "source_lang", F.explode(registry_entries(models)).alias("_m"))
    lang_map = F.col("_m.language_map")
    return fanned.select(
        "record_id", F.col("_m.model").alias("model"), F.col("source_lang"), target.alias("target_lang"),
        F.coalesce(F.try_element_at(lang_map, F.col("source_lang")), F.col("source_lang")).alias("src_code"),
        F.coalesce(F.try_element_at(lang_map, target), target).alias("tgt_code"))


def train_sizes(split_records: DataFrame, reg: DataFrame, models=K.MODEL_REGISTRY) -> DataFrame:
    """Op 72: rows (and source characters) per split after the validity filter and the language restriction,
    and steps per epoch. Records are counted by (source language, split) first, so the fan-out to models
    is over those few rows."""
    from .gates import drop_invalid_examples
    few = drop_invalid_examples(split_records).groupBy("source_lang", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("source")).alias("chars"))
    fanned = few.select("*", F.explode(registry_entries(models)).alias("_m")).withColumn("model", F.col("_m.model"))
    restrict = F.col("_m.restrict_source_language")
    of = lambda value, split: F.coalesce(F.sum(F.when(F.col("split") == split, F.col(value))), F.lit(0)).cast("long")
    names = {f"{split}_{out}": of(value, split) for split in ("train", "eval") for value, out in (("n", "rows"), ("chars", "chars"))}
    counts = fanned.where(restrict.isNull() | (F.col("source_lang") == restrict)).groupBy("model") \
                   .agg(*[v.alias(k) for k, v in names.items()])
    r = F.broadcast(reg.select("model", "batch_size", "grad_accum"))
    out = r.join(counts, "model", "left").na.fill(0, list(names))
    steps = F.ceil(F.col("train_rows") / (F.col("batch_size") * F.col("grad_accum")).cast("double"))
    return out.select("model", "train_rows", "eval_rows", steps.cast("long").alias("steps_per_epoch"), "train_chars", "eval_chars")


def capped_samples(train: int = K.SWEEP_TRAIN_SAMPLES, evaluation: int = K.SWEEP_EVAL_SAMPLES) -> list[Column]:
    """Sample counts of a sweep trial: a split's rows, after the cap."""
    return [F.least(F.col("train_rows"), F.lit(train)).cast("long").alias("train_samples"),
            F.least(F.col("eval_rows"), F.lit(evaluation)).cast("long").alias("eval_samples")]


# --- default tokenizer (op 73) ------------------------------------------------------------------------

def token_counts(rows: DataFrame, cols: tuple[str, ...], out_col: str = "n") -> DataFrame:
    """(token, ``out_col``): whitespace tokens of the text columns and how often they occur. A task counts the tokens
    of each Arrow batch, so that a row a batch and distinct token is shuffled."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter()
            for column in batch.columns:
                for text in column.to_pylist():
                    found.update((text or "").split())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["token", "n"])

    return rows.select(*cols).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias(out_col))


def word_vocabulary(records: DataFrame) -> DataFrame:
    """(token, token_id): whitespace tokens of sources and targets by (count desc, token asc)."""
    counts = token_counts(records, ("source", "target"), "count")
    ranked = with_ordinal(counts, order=[F.col("count").desc(), F.col("token").asc()], out_col="rank")
    token_id = F.col("rank") + FIRST_WORD_ID
    # ids are 31-bit: words ranked beyond them are unknown words
    return ranked.select("token", F.when(token_id <= _ID_MASK, token_id).otherwise(F.lit(UNK_ID).cast("long")).alias("token_id"))


_SIDE_SHIFT, _POS_SHIFT, _ID_MASK = 62, 31, (1 << 31) - 1


def _pack(side: Column, pos: Column, token_id: Column) -> Column:
    """side (1 bit) | position (31 bits) | token id (31 bits) in one long."""
    return (F.shiftleft(side.cast("long"), _SIDE_SHIFT)
            .bitwiseOR(F.shiftleft(pos.cast("long"), _POS_SHIFT))
            .bitwiseOR(token_id.cast("long")))


def tokenize_records(records: DataFrame, vocab: DataFrame, max_source_len: int = K.MAX_SOURCE_LEN,
                     max_target_len: int = K.MAX_TARGET_LEN, partition_keys: tuple[str, ...] = ()) -> DataFrame:
    """Strip, tokenise source -> input_ids and target -> labels, truncate (end token included),
    drop empty targets; the m2m100-style per-row decoder inputs start with the target language id.

    A vocabulary whose rows and bytes are within the bound is sent to the tasks, which look up the distinct
    tokens of each Arrow batch: nothing is exploded, shuffled or sorted. With a larger one both sides are exploded
    together, shuffle-joined (with AQE skew handling for hot words) and re-assembled with a single group-by on
    record_id: one shuffle of the tokens. When the records arrive partitioned by a coarser key (``partition_keys``,
    e.g. pair_id of a bucketed pair table), grouping by it as well lets Spark reuse that partitioning and skip the shuffle.
    """
    if is_small(vocab, VOCAB_BROADCAST_MAX_ROWS):
        sides = records.where(F.length(T.py_strip("target")) > 0).select(
            "record_id", "source_lang", F.col("source").alias("input_ids"), F.col("target").alias("labels"))
        return _with_decoder_inputs(_look_up(sides, vocab, {"input_ids": max_source_len, "labels": max_target_len}))
    # a tag of its own keeps rows apart that share an id
    valid = records.where(F.length(T.py_strip("target")) > 0).withColumn("_row", F.monotonically_increasing_id())
    sides = F.array(F.struct(F.lit(0).alias("side"), T.whitespace_tokens(T.py_strip("source")).alias("toks")),
                    F.struct(F.lit(1).alias("side"), T.whitespace_tokens(T.py_strip("target")).alias("toks")))
    keys = [*partition_keys, "record_id", "source_lang", "_row"]
    per_side = valid.select(*keys, F.inline(sides))
    toks = per_side.select(*keys, "side", F.posexplode("toks").alias("pos", "token"))
    # truncation before the shuffle: tokens past the length limit never leave their task
    keep = F.when(F.col("side") == 0, F.col("pos") < max_source_len - 1).otherwise(F.col("pos") < max_target_len - 1)
    ided = (toks.where(keep)
                .join(vocab, "token", "left")
                .select(*keys, _pack(F.col("side"), F.col("pos"), F.coalesce("token_id", F.lit(UNK_ID))).alias("_p")))
    # one long per token in the shuffle; sorting the longs sorts by (side, pos)
    grouped = ided.groupBy(*keys).agg(F.array_sort(F.collect_list("_p")).alias("_s"))

    def ids(side: int, max_len: int):
        picked = F.transform(F.filter("_s", lambda x: F.shiftright(x, _SIDE_SHIFT) == side),
                             lambda x: x.bitwiseAND(F.lit(_ID_MASK)).cast("int"))
        return F.concat(F.slice(picked, 1, max_len - 1), F.array(F.lit(EOS_ID)))

    out = grouped.select("record_id", "source_lang", ids(0, max_source_len).alias("input_ids"),
                         ids(1, max_target_len).alias("labels"))
    return _with_decoder_inputs(out)


def _look_up(rows: DataFrame, vocab: DataFrame, cols: dict[str, int]) -> DataFrame:
    """The texts of ``cols`` as ids of their whitespace tokens, up to the column's number of ids with the end token;
    the other columns unchanged. ``vocab`` is small."""
    ship_package(rows.sparkSession)
    known = vocab.select("token", F.col("token_id").cast("int").alias("token_id")).toArrow()
    sent = rows.sparkSession.sparkContext.broadcast([_one_array(known.column(n)) for n in known.column_names])

    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, numbers = sent.value
        numbers = pa.concat_arrays([numbers, pa.array([UNK_ID], pa.int32())])
        for batch in batches:
            known: dict[str, int] = {}  # the batch's distinct tokens, numbered as they come
            coded = {}
            for name, most in cols.items():
                tokens = [(t or "").split(None, most - 1)[:most - 1] for t in batch.column(name).to_pylist()]
                coded[name] = np.array([len(t) for t in tokens], np.int64), \
                    np.fromiter((known.setdefault(w, len(known)) for t in tokens for w in t), np.int64)
            found = pc.index_in(pa.array(list(known), words.type), value_set=words).fill_null(len(words))
            ids, out = numbers.take(found).to_numpy(), {}
            for name, (lengths, places) in coded.items():
                ends = np.cumsum(lengths + 1)
                values = np.full(int(ends[-1]) if len(ends) else 0, EOS_ID, np.int32)
                inner = np.ones(len(values), bool)
                inner[ends - 1] = False
                values[inner] = ids[places]
                out[name] = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), values)
            yield pa.RecordBatch.from_arrays([out[n] if n in cols else batch.column(n) for n in names], names=names)

    schema = Ty.StructType([Ty.StructField(f.name, Ty.ArrayType(Ty.IntegerType()) if f.name in cols else f.dataType) for f in rows.schema.fields])
    return rows.mapInArrow(run, schema)


def _one_array(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _with_decoder_inputs(out: DataFrame) -> DataFrame:
    lang_id = F.when(F.col("source_lang") == "fr", F.lit(LANG_IDS["en"])).otherwise(F.lit(LANG_IDS["fr"]))
    shifted = F.transform(F.slice("labels", 1, F.size("labels") - 1),
                          lambda t: F.when(t == K.LABEL_PAD_ID, F.lit(PAD_ID)).otherwise(t))
    return out.withColumn("decoder_input_ids", F.concat(F.array(lang_id), shifted)).drop("source_lang")


def shift_and_pad(tokens: DataFrame, positions: DataFrame, batch_size: int, partition_key: str | None = None) -> DataFrame:
    """Op 74 (b): batches of ``batch_size`` consecutive positions per split; inputs padded with the
    pad id, labels with -100, attention mask, and decoder inputs = [first label] + labels[:-1] with
    -100 turned into the pad id. Only lengths are gathered by batch; the token arrays meet their
    batch's two numbers in one join on record_id.

    ``partition_key`` is a column of both tables that is the same for all rows of a record_id and that the tokens are
    bucketed by: rows then meet on it alone, and their record_ids are compared where they meet, so that the token
    arrays are not shuffled."""
    key = partition_key or "record_id"
    keys = list(dict.fromkeys([key, "record_id"]))

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        if not partition_key:
            return left.join(right, "record_id")
        # as a range, so that it is no key of the join: Spark would want both sides partitioned by it too
        same = (F.col("l.record_id") <= F.col("r.record_id")) & (F.col("l.record_id") >= F.col("r.record_id"))
        # nor is a table of numbers to be broadcast for its small files
        return left.alias("l").join(right.hint("merge").alias("r"), (F.col(f"l.{key}") == F.col(f"r.{key}")) & same) \
                   .select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in keys])

    lengths = tokens.select(*keys, F.size("input_ids").alias("_in"), F.size("labels").alias("_lab"))
    w = Window.partitionBy("split", "batch_id")  # at most batch_size rows of numbers
    batches = meet(lengths, positions) \
        .select(*keys, "split", F.floor(F.col("position") / F.lit(batch_size)).cast("long").alias("batch_id"), "_in", "_lab") \
        .select(*keys, "split", "batch_id", F.max("_in").over(w).alias("_in_len"), F.max("_lab").over(w).alias("_lab_len"))
    b = meet(tokens, batches)
    pad_in = F.col("_in_len") - F.size("input_ids")
    pad_lab = F.col("_lab_len") - F.size("labels")
    labels = F.concat("labels", F.array_repeat(F.lit(K.LABEL_PAD_ID), pad_lab))
    as_pad = F.transform(labels, lambda t: F.when(t == K.LABEL_PAD_ID, F.lit(PAD_ID)).otherwise(t))
    return b.select(
        "record_id", "split", "batch_id",
        F.concat("input_ids", F.array_repeat(F.lit(PAD_ID), pad_in)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("input_ids")), F.array_repeat(F.lit(0), pad_in))
         .alias("attention_mask"),
        labels.alias("labels"),
        F.concat(F.slice(as_pad, 1, 1), F.slice(as_pad, 1, F.col("_lab_len") - 1)).alias("decoder_input_ids"),
    )
