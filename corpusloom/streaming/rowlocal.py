"""The row-local part of the curation chain on a streaming DataFrame.

Everything before the corpus-wide accent vocabulary is a projection of one row (ratios, counts,
apostrophe repair, figure/date flags, similarity tiers), so the same expressions run unchanged on
a stream of new pair files. The accent pass needs the whole corpus and stays a batch step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..operators import gates as G
from ..plans.curation import feature_columns
from ..sources.corpus import PAIR_SCHEMA

ROW_LOCAL_FEATURES = [f for f in K.FEATURES if f != "potential_fr_accent_issues"]


def row_local_flags(pairs: DataFrame) -> DataFrame:
    """Features before the accent pass, plus every flag that needs only the row itself. A NaN similarity is
    missing, as in the batch chain."""
    feats = feature_columns(pairs.withColumn("similarity", F.nanvl(F.col("similarity"), F.lit(None).cast("double"))))
    en_flags = T.figtext_flags("en", "en")
    fr_flags = T.figtext_flags("fr_apos", "fr")
    cols = {"exclude_low_similarity": G.low_similarity()}
    cols.update(G.tiered_bounds(features=ROW_LOCAL_FEATURES))
    cols["exclude_figtext"] = en_flags["exclude_figtext"] | fr_flags["exclude_figtext"]
    cols["has_date_refs"] = T.has_date_refs("en", "fr_apos")
    return feats.withColumns(cols)


def read_pair_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 100) -> DataFrame:
    return (spark.readStream.schema(PAIR_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
                 .parquet(folder))


def flag_pair_stream(spark: SparkSession, source_folder: str, sink_folder: str, checkpoint_folder: str):
    """Process every pair file present now (``availableNow``) into a Parquet sink; returns the query."""
    stream = row_local_flags(read_pair_stream(spark, source_folder))
    return (stream.writeStream.format("parquet").option("path", sink_folder)
                  .option("checkpointLocation", checkpoint_folder)
                  .trigger(availableNow=True).start())
