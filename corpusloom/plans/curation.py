"""Entry 1 of the original project as one lazy DataFrame chain, written out stage by stage.

pairs -> features (ratios, annotation counts, one-character words; pre-repair text)
      -> apostrophe repair -> accent vocabulary -> accent repair -> uncommon-word count
      -> gate flags.

Stage order matters: ratios and one-character counts are computed before any repair and never
recomputed, while the figure, date and accent checks see the repaired French.

Stages are written as Parquet tables into the shared checkpoint folder (the Spark counterpart of the
original's pickle after each script) and memoised per session, so every query over the same data
reuses them, with column pruning and pushdown into each stage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..operators import accent as A
from ..operators import gates as G
from ..operators import profile as PR
from ..operators import tagger as TG
from ..session import Scope, bucket_count, materialize, materialize_observed
from . import fixtures as X

VERB_RE = r"(?d)(ing|ed|er)([ .,;!?]|$)"
NOUN_RE = r"(?d)(tion|ment|ness)([ .,;!?]|$)"
ENTITY_RE = r"(?d)(^| )[A-Z][a-z]+"


def annotate_counts(df: DataFrame, cols=("fr", "en")) -> DataFrame:
    """Op 18, default annotator: verb, noun and entity counts per language from regex rules."""
    out = {}
    for c in cols:
        lang = c.split("_")[0]
        out[f"verbs_{lang}"] = F.regexp_count(F.col(c), F.lit(VERB_RE)).cast("long")
        out[f"nouns_{lang}"] = F.regexp_count(F.col(c), F.lit(NOUN_RE)).cast("long")
        out[f"entities_{lang}"] = F.regexp_count(F.col(c), F.lit(ENTITY_RE)).cast("long")
    return df.withColumns(out)


COUNT_COLUMNS = [f"{n}_{lang}" for lang in ("fr", "en") for n in ("verbs", "nouns", "entities")]


def feature_columns(pairs: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Feature tables v1 and v2 (before the accent pass). ``counts`` (pair_id and COUNT_COLUMNS) replaces the
    default annotator's counts; a pair without a row there has missing ratios."""
    annotated = annotate_counts(pairs) if counts is None else \
        pairs.join(counts.select("pair_id", *COUNT_COLUMNS), "pair_id", "left")
    return annotated.select(
        "pair_id",
        F.col("fr").alias("fr_raw"),
        "en",
        "similarity",
        T.len_ratio("fr", "en").alias("len_ratio"),
        T.add_one_ratio("verbs_fr", "verbs_en").alias("verb_ratio"),
        T.add_one_ratio("nouns_fr", "nouns_en").alias("noun_ratio"),
        T.add_one_ratio("entities_fr", "entities_en").alias("entity_ratio"),
        T.clause_ratio("fr", "en").alias("clause_ratio"),
        T.one_char_words("fr", K.ONE_CHAR_ALLOW_FR).cast("long").alias("one_char_words_fr"),
        T.one_char_words("en", K.ONE_CHAR_ALLOW_EN).cast("long").alias("one_char_words_en"),
        T.repair_apostrophes(F.col("fr")).alias("fr_apos"),
    )


@dataclass
class Curation:
    """The stage chain over one corpus. Pairs and lexicon come either from the driver's tables in
    ``sf_dir`` (the fixture recipe) or from the caller (``curate``).

    A stage holds each text once and only what it adds: ``pairs`` the two texts, ``features_pre`` the French
    text after the apostrophe repair, ``features`` the one after the accent repair, the others none. What a
    query reads are joins of these tables on the ``pair_id`` that they are bucketed by (no shuffle)."""
    spark: SparkSession
    sf_dir: str | None
    cutoff: int = K.ACCENT_MAP_SIZE
    pairs_source: DataFrame | None = None
    lexicon_source: DataFrame | None = None
    skip_identity: bool = False
    counts_source: DataFrame | None = None
    tagger: TG.Tagger | str | None = None

    def __post_init__(self):
        self._memo: dict[str, DataFrame] = {}
        self._stages = Scope(self.spark)
        self._buckets: int | None = None
        self.observed: dict[str, dict[str, object]] = {}
        self.subword_models: dict[int, object] = {}
        self.clustered: dict[str, str] = {}

    def stage(self, name: str, build, bucket_by: str | None = None, metrics: dict | None = None,
              placed: bool = False) -> DataFrame:
        """The written table ``name``; intermediate tables of its build (ranks, offsets) are deleted. ``metrics``
        (aggregates) are observed while it is written and kept in ``self.observed[name]``. ``placed``: as in ``materialize``."""
        if name not in self._memo:
            with Scope(self.spark) as owned:
                built = build()
                if bucket_by and self._buckets is None:
                    self._buckets = bucket_count(built)
                if metrics is None:
                    table = materialize(built, f"stage-{name}", bucket_by, self._buckets, placed)
                else:
                    table, self.observed[name] = materialize_observed(built, f"stage-{name}", metrics, bucket_by, self._buckets)
                self._stages.adopt(owned.release())
            self._memo[name] = table
        return self._memo[name]

    def close(self) -> None:
        """Delete all stage tables of this chain."""
        self._memo.clear()
        self._stages.drop()

    # -- stages ---------------------------------------------------------------------------------
    def pairs(self) -> DataFrame:
        if self.pairs_source is not None:
            return self.stage("pairs", lambda: _checked_pairs(self.pairs_source), "pair_id")
        return self.stage("pairs", lambda: X.derive_pairs(self.spark, self.sf_dir, bucketed=True), "pair_id")

    def pairs_once(self) -> DataFrame:
        """The pairs for a query that reads them once and by no key: the stage if it is there, else the derivation
        itself, neither bucketed nor written. To be read within a ``Scope``, which owns what the derivation writes."""
        if "pairs" in self._memo or self.pairs_source is not None:
            return self.pairs()
        return X.derive_pairs(self.spark, self.sf_dir)

    def lexicon(self) -> DataFrame:
        if self.lexicon_source is not None:
            return self.stage("lexicon", lambda: self.lexicon_source.select(F.col("word").cast("string")).distinct())
        return self.stage("lexicon", lambda: X.derive_lexicon(self.spark, self.sf_dir))

    def learned_tagger(self) -> TG.Tagger:
        """The caller's tagger, or one trained (once) on both sides of all pairs."""
        if not isinstance(self.tagger, TG.Tagger):
            side = lambda c: self.pairs().select(F.lit(c).alias("lang"), F.col(c).alias("text"))
            self.tagger = TG.train(side("fr").union(side("en")))
        return self.tagger

    def counts(self) -> DataFrame | None:
        """The annotation counts that replace the default annotator's: a caller's, or the tagger's."""
        if self.counts_source is not None or self.tagger is None:
            return self.counts_source
        return self.stage("tag_counts", lambda: TG.count_tags(self.pairs(), self.learned_tagger()), "pair_id")

    def features_pre(self) -> DataFrame:
        """pair_id, similarity, the numbers of feature tables v1 and v2, and ``fr_apos``."""
        return self.stage("features_pre", lambda: feature_columns(self.pairs(), self.counts()).drop("fr_raw", "en"), "pair_id")

    def raw_texts(self) -> DataFrame:
        return self.pairs().select("pair_id", F.col("fr").alias("fr_raw"), "en")

    def accent_mapping(self) -> DataFrame:
        return self.stage("accent_mapping",
                           lambda: A.accent_mapping(A.accent_counts(self.features_pre(), "fr_apos")))

    def lexicon_split(self) -> DataFrame:
        return A.lexicon_split(self.accent_mapping(), self.lexicon())

    def vocabulary(self) -> DataFrame:
        return self.stage("vocabulary",
                          lambda: A.top_words(self.lexicon_split(), self.cutoff, self.skip_identity))

    def uncommon_words(self) -> DataFrame:
        return self.vocabulary().where(~F.col("in_map")).select(F.col("anglicised").alias("word"))

    def features_core(self) -> DataFrame:
        """The numbers of the feature table after both repairs, and the repaired ``fr``."""
        def build():
            # only the changed runs are shuffled; the join leaves the rows hash-partitioned by
            # pair_id, so the uncommon-word count (broadcast lookup, per-pair count, join) adds none
            pre = self.features_pre()
            changes = A.accent_changes(pre, self.vocabulary(), self.cutoff, "fr_apos")
            fixed = A.apply_changes(pre, changes, "fr_apos", "fr").drop("fr_apos")
            return A.word_list_hits(fixed, self.uncommon_words(), "fr", "potential_fr_accent_issues")
        return self.stage("features", build, "pair_id")

    def features(self) -> DataFrame:
        """Feature table after both repairs, with the uncommon-word count and every snapshot of the texts."""
        return self.features_core().join(self.features_pre().select("pair_id", "fr_apos"), "pair_id") \
                   .join(self.raw_texts(), "pair_id")

    def gate_flags(self) -> DataFrame:
        """pair_id, similarity, uncommon-word count and the flags of the gate, without texts."""
        def build():
            core = self.features_core()
            gated = G.add_gate_columns(core.join(self.pairs().select("pair_id", "en"), "pair_id"))
            new = [c for c in gated.columns if c not in core.columns and c != "en"]
            return gated.select("pair_id", "similarity", "potential_fr_accent_issues", *new)
        return self.stage("gate_flags", build, "pair_id", PR.gate_metrics())

    def gate_metrics(self) -> dict[str, object]:
        """Ops 66 and 67 without a job of their own: observed when the gate's flags were written."""
        self.gate_flags()
        return self.observed["gate_flags"]

    def gated(self) -> DataFrame:
        """The feature table with the gate's flags."""
        return self.features().join(self.gate_flags().drop("similarity", "potential_fr_accent_issues"), "pair_id")


class PairKeyError(ValueError):
    pass


def _checked_pairs(df: DataFrame) -> DataFrame:
    """A caller's pair table: schema and keys checked, NaN similarity read as missing."""
    from ..sources.corpus import PAIR_SCHEMA, check_schema
    out = check_schema(df, PAIR_SCHEMA)
    bad = out.groupBy("pair_id").count().where(F.col("pair_id").isNull() | (F.col("count") > 1)).orderBy("pair_id").limit(1).collect()
    if bad:
        raise PairKeyError(f"pair_id must be unique and not null; {bad[0]['pair_id']} occurs {bad[0]['count']} times")
    return out.withColumn("similarity", F.nanvl(F.col("similarity"), F.lit(None).cast("double")))


def curate(spark: SparkSession, pairs: DataFrame, lexicon: DataFrame, cutoff: int = K.ACCENT_MAP_SIZE,
           skip_identity: bool = False, counts: DataFrame | None = None, tagger: TG.Tagger | str | None = None) -> Curation:
    """The curation chain over a caller's own pair table (pair_id, fr, en, similarity) and French
    lexicon (word). ``curate(...).gated()`` is the flag table; ``training_pairs`` / ``relaxed_test_pairs``
    in ``operators.gates`` give the two outputs. ``counts`` (pair_id and COUNT_COLUMNS, for example from
    ``plugins.annotate_with``) replaces the default annotator: the ratios and the gate then follow it. So does
    ``tagger``: a trained ``operators.tagger.Tagger``, or "learn" to train one on these pairs."""
    if counts is not None and tagger is not None:
        raise ValueError("counts and tagger both replace the default annotator: give one of them")
    return Curation(spark, None, cutoff, pairs_source=pairs, lexicon_source=lexicon, skip_identity=skip_identity,
                    counts_source=counts, tagger=tagger)


_SESSIONS: dict[tuple, Curation] = {}


def _identity(spark: SparkSession, folder: str) -> tuple:
    """Name, length and change time of the input files, from a listing: a changed input is another corpus."""
    conf, found = spark._jsc.hadoopConfiguration(), []
    for name in ("documents", "embeddings"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            found += [(f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)]
    return tuple(found)


def curation(spark: SparkSession, sf_dir: str, cutoff: int = K.ACCENT_MAP_SIZE, tagger: str | None = None) -> Curation:
    folder = sf_dir.rstrip("/")
    key = (spark.sparkContext.applicationId, folder, cutoff, tagger, _identity(spark, folder))
    if key not in _SESSIONS:
        _SESSIONS[key] = Curation(spark, folder, cutoff, tagger=tagger)
    return _SESSIONS[key]
