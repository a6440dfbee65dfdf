"""Sources and sinks (ops 1-3, 5-11). Readers always pass an explicit schema; writers are Spark's
parallel file sinks. Writers return the folder they wrote so callers can read it back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from .. import constants as K

PAIR_SCHEMA = Ty.StructType([
    Ty.StructField("pair_id", Ty.LongType(), False),
    Ty.StructField("fr", Ty.StringType(), True),
    Ty.StructField("en", Ty.StringType(), True),
    Ty.StructField("similarity", Ty.DoubleType(), True),
])
CORPUS_SCHEMA = Ty.StructType([
    Ty.StructField("source", Ty.StringType(), True),
    Ty.StructField("target", Ty.StringType(), True),
    Ty.StructField("source_lang", Ty.StringType(), True),
])
PROMPT_SCHEMA = Ty.StructType([Ty.StructField("text", Ty.StringType(), True)])
COMPARISON_SCHEMA = Ty.StructType([
    Ty.StructField("source", Ty.StringType(), True),
    Ty.StructField("target", Ty.StringType(), True),
    Ty.StructField("source_lang", Ty.StringType(), True),
    Ty.StructField("other_lang", Ty.StringType(), True),
    Ty.StructField("translator_name", Ty.StringType(), True),
    Ty.StructField("translated_text", Ty.StringType(), True),
    Ty.StructField("cosine_similarity_original_translation", Ty.DoubleType(), True),
    Ty.StructField("cosine_similarity_vs_source", Ty.DoubleType(), True),
    Ty.StructField("cosine_similarity_vs_target", Ty.DoubleType(), True),
])
SWEEP_SCHEMA = Ty.StructType([
    Ty.StructField("trial_dir", Ty.StringType(), True),
    Ty.StructField("lr", Ty.DoubleType(), True),
    Ty.StructField("lora_r", Ty.IntegerType(), True),
    Ty.StructField("lora_alpha", Ty.IntegerType(), True),
    Ty.StructField("lora_dropout", Ty.DoubleType(), True),
    Ty.StructField("train_samples", Ty.LongType(), True),
    Ty.StructField("eval_samples", Ty.LongType(), True),
    Ty.StructField("final_train_loss", Ty.DoubleType(), True),
    Ty.StructField("final_eval_loss", Ty.DoubleType(), True),
])
# blanks around a text are kept; a missing value is written as \\N and an empty text as "", so they stay apart
_CSV = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"', "nullValue": "\\N",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
CSV_READ = {**_CSV, "emptyValue": ""}
# a multi-line CSV file is read by one task, so the rows of a file are bounded
CSV_WRITE = {**_CSV, "emptyValue": '""', "maxRecordsPerFile": "200000"}


def check_schema(df: DataFrame, schema: Ty.StructType) -> DataFrame:
    """Fail early when a table lacks a column or has it with an incompatible type; numeric columns
    of another width (int ids, float similarities from a pandas export) are cast."""
    have = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for f in schema.fields:
        if f.name not in have:
            raise ValueError(f"missing column {f.name}")
        got = have[f.name]
        if got == f.dataType:
            cols.append(F.col(f.name))
        elif isinstance(got, Ty.NumericType) and isinstance(f.dataType, Ty.NumericType):
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            raise ValueError(f"column {f.name} is {got.simpleString()}, expected {f.dataType.simpleString()}")
    return df.select(*cols)


def read_pairs(spark: SparkSession, path: str, schema: Ty.StructType = PAIR_SCHEMA) -> DataFrame:
    """Op 1: a pair or feature table; NaN similarity becomes NULL on the way in."""
    df = check_schema(spark.read.parquet(path), schema)
    if "similarity" in df.columns:
        df = df.withColumn("similarity", F.nanvl(F.col("similarity"), F.lit(None).cast("double")))
    return df


def write_pairs(df: DataFrame, path: str) -> str:
    """Op 2: stage checkpoint as Parquet (re-read it to cut lineage)."""
    df.write.mode("overwrite").parquet(path)
    return path


def read_corpus(spark: SparkSession, path: str, schema: Ty.StructType = CORPUS_SCHEMA) -> DataFrame:
    """Op 3: JSON-lines records with a fixed schema, no inference pass."""
    return spark.read.schema(schema).json(path)


def write_corpus(records: DataFrame, path: str) -> str:
    """Op 5: UTF-8 JSON lines, non-ASCII kept raw, keys in the order source, target, source_lang.
    Records with a missing side are not written."""
    (records.select("source", "target", "source_lang").where("source IS NOT NULL AND target IS NOT NULL")
            .write.mode("overwrite").option("ignoreNullFields", "false").json(path))
    return path


def _fill(template: str) -> Column:
    """A ``{fr}`` / ``{en}`` template as a concat of literals and columns."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(fr|en)\}", template)):
        parts.append(F.col(piece) if i % 2 else F.lit(piece))
    return F.concat(*parts)


def prompt_records(pairs: DataFrame) -> DataFrame:
    """Op 6 records: French-to-English first, then English-to-French; pairs with a missing side have none."""
    return pairs.where("fr IS NOT NULL AND en IS NOT NULL").select("pair_id", F.inline(F.array(
        F.struct(F.lit(0).alias("direction"), _fill(K.PROMPT_FR_TO_EN).alias("text")),
        F.struct(F.lit(1).alias("direction"), _fill(K.PROMPT_EN_TO_FR).alias("text")))))


def write_prompt_corpus(pairs: DataFrame, path: str) -> str:
    prompt_records(pairs).select("text").write.mode("overwrite").json(path)
    return path


def read_scores(spark: SparkSession, path: str, schema: Ty.StructType) -> DataFrame:
    """Op 7: CSV with a header; quoted fields may hold quotes and line breaks."""
    return spark.read.schema(schema).options(**CSV_READ).csv(path)


def write_comparison(comparison: DataFrame, root: str, run_id: str) -> str:
    """Op 8: the nine-column comparison CSV under a run-stamped name (the run id is passed in). A sample's texts stand in
    a row for each translator, so the part files are gzipped; a multi-line file is read by one task anyway."""
    path = f"{root.rstrip('/')}/translation_comparison_{run_id}.csv"
    comparison.select(*[f.name for f in COMPARISON_SCHEMA.fields]) \
              .write.mode("overwrite").options(**CSV_WRITE, compression="gzip").csv(path)
    return path


def append_sweep_results(trials: DataFrame, path: str, run_id: str | None = None) -> str:
    """Op 9: append trial rows (header in every part file; readers skip it), partitioned by model. With a ``run_id``
    the rows belong to that run: they replace what an earlier try of the same run left (its partitions are
    overwritten in one commit) and stand beside other runs', so a retry leaves one copy and a failed try none."""
    rows = trials.select(*[f.name for f in SWEEP_SCHEMA.fields], "model")
    if run_id is None:
        rows.write.mode("append").partitionBy("model").options(**CSV_WRITE).csv(path)
    else:
        rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("run_id", "model").options(**CSV_WRITE).csv(path)
    return path


def read_sweep_results(spark: SparkSession, path: str) -> DataFrame:
    """The trials of all runs that were appended with a ``run_id``."""
    schema = Ty.StructType([*SWEEP_SCHEMA.fields, Ty.StructField("run_id", Ty.StringType()), Ty.StructField("model", Ty.StringType())])
    return spark.read.schema(schema).options(**CSV_READ).csv(path)


STATS = "_file_ranges"


def write_clustered(df: DataFrame, path: str, by: str, files: int, digest_of: str | None = None) -> str:
    """Ops 48 and 49: a copy of ``df`` in about ``files`` files that are ranges of ``by`` (missing values in one of
    them), with each file's range in a small table beside them. With ``digest_of`` a column ``text_digest`` has that
    column's digest and a Parquet Bloom filter, so a lookup opens only row groups that may have it."""
    rows = df if digest_of is None else df.withColumn("text_digest", F.xxhash64(digest_of))
    writer = rows.repartitionByRange(files, F.col(by).asc_nulls_first()).sortWithinPartitions(F.col(by).asc_nulls_first()).write.mode("overwrite")
    if digest_of is not None:
        writer = writer.option("parquet.bloom.filter.enabled#text_digest", "true")
    writer.parquet(f"{path}/rows")
    ranges = df.sparkSession.read.parquet(f"{path}/rows").groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min(by).alias("low"), F.max(by).alias("high"), F.count_if(F.col(by).isNull()).alias("n_missing"))
    ranges.write.mode("overwrite").parquet(f"{path}/{STATS}")
    return path


def read_range(spark: SparkSession, path: str, by: str, low: float, high: float) -> DataFrame:
    """Op 48 on a clustered copy: the rows with ``low <= by <= high``. Only files whose range meets the band are
    opened (the table of ranges has a row a file), and in them the filter is pushed to the row groups."""
    ranges = spark.read.parquet(f"{path}/{STATS}").where((F.col("low") <= F.lit(high)) & (F.col("high") >= F.lit(low)))
    files = [f"{path}/rows/{r.file}" for r in ranges.select("file").toLocalIterator()]
    whole = spark.read.parquet(f"{path}/rows")
    rows = spark.read.schema(whole.schema).parquet(*files) if files else whole.limit(0)
    return rows.where(F.col(by).between(F.lit(low), F.lit(high)))


def read_text(spark: SparkSession, path: str, text_col: str, text: str) -> DataFrame:
    """Op 49 on a clustered copy: the rows whose ``text_col`` (the column given as ``digest_of``) is ``text``."""
    digest = spark.range(1).select(F.xxhash64(F.lit(text)).alias("d")).first()["d"]
    return spark.read.parquet(f"{path}/rows").where((F.col("text_digest") == F.lit(digest)) & (F.col(text_col) == F.lit(text)))


def sink_stats(spark: SparkSession, path: str) -> DataFrame:
    """Op 10: size in KB and line count of a written text sink (all part files), in one pass."""
    per_file = (spark.read.text(path)
                     .select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s"))
                     .groupBy("f").agg(F.first("s").alias("s"), F.count(F.lit(1)).alias("n")))
    return per_file.agg(F.round(F.coalesce(F.sum("s"), F.lit(0)) / 1024.0, 2).alias("size_kb"),
                        F.coalesce(F.sum("n"), F.lit(0)).alias("line_count"))


REPORT_SEPARATOR = "\x1e"


def comparison_report(samples: DataFrame) -> DataFrame:
    """Op 11: one multi-line text block per sample (index, language, source, expected, base and
    fine-tuned outputs). ``samples`` carries sample_no, n_samples and the four texts."""
    block = F.format_string(
        K.COMPARISON_REPORT,
        F.col("sample_no"), F.col("n_samples"), F.col("source_lang"), F.col("source"), F.col("target"),
        F.col("base_output"), F.col("finetuned_output"))
    return samples.select(block.alias("value"))


def write_report(report: DataFrame, path: str) -> str:
    report.write.mode("overwrite").option("lineSep", REPORT_SEPARATOR).text(path)
    return path


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", REPORT_SEPARATOR).text(path)


def model_from_filename(df: DataFrame) -> DataFrame:
    """Op 41: model name = file (or folder) name up to the first underscore."""
    parent = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    name = F.when(parent.endswith(".csv"), parent).otherwise(F.col("_metadata.file_name"))
    return df.withColumn("model_name", F.substring_index(name, "_", 1))
