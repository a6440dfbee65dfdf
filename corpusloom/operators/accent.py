"""The accent repair loop: a corpus-wide vocabulary aggregate that feeds back into row edits.

Ops 25 (accented tokens), 68 (accent map), 55 (lexicon split), 76 (top words), 26 (replacement)
and 27 (word-list hits). Shuffles: one partial+final aggregate over accented tokens, a window per
anglicised form (groups are the handful of spellings of one word), one distributed ranking of the
vocabulary, and joins of the token stream against word lists.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from .bloom import build, keep_candidates
from .ordinal import with_ordinal
from .sizing import is_small

# The replacement map (at most `cutoff` rows) is broadcast up to this many entries; above it the
# lookup becomes a shuffle join of word runs, which has no size limit.
MAP_BROADCAST_MAX_ENTRIES = 200_000
# Word lists up to this many rows are broadcast for the hit count; larger ones shuffle-join
# (AQE's skew-join handling splits hot words).
LIST_BROADCAST_MAX_ROWS = 2_000_000


def accented_tokens(df: DataFrame, text_col: str = "fr", key: str = "pair_id") -> DataFrame:
    """Op 25: one row per accented token, in token order within each row."""
    return df.select(key, F.posexplode(T.accented_token_list(text_col)).alias("token_pos", "accented"))


def accent_counts(df: DataFrame, text_col: str = "fr") -> DataFrame:
    """(accented, anglicised, count): partial aggregation combines hot words before the shuffle."""
    # an outer explode, as Spark would work the list out again in a filter below any other
    toks = df.select(F.explode_outer(T.accented_token_list(text_col)).alias("accented")).where("accented is not null")
    return (toks.groupBy("accented").agg(F.count(F.lit(1)).alias("count"))
                .withColumn("anglicised", T.strip_accents("accented")))


def accent_mapping(counts: DataFrame) -> DataFrame:
    """Op 68: number of accented spellings per anglicised form, and the rank of each spelling.

    ``form_rank > 1`` are the later copies the original lists as ambiguous; ``n_forms = 1`` are the
    unambiguous entries that may be used for repair.
    """
    by_form = Window.partitionBy("anglicised")
    ordered = by_form.orderBy(F.col("count").desc(), F.col("accented").asc())
    return (counts.withColumn("n_forms", F.count(F.lit(1)).over(by_form))
                  .withColumn("form_rank", F.row_number().over(ordered)))


def lexicon_split(mapping: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Op 55: unambiguous entries tagged with whether the anglicised form is a real word.

    Both sides are distinct vocabularies; the join is left outer on the word. AQE broadcasts the
    lexicon when its runtime size is small and shuffles otherwise.
    """
    lex = lexicon.select(F.col("word").alias("anglicised")).distinct().withColumn("in_lexicon", F.lit(True))
    unamb = mapping.where(F.col("n_forms") == 1).select("anglicised", "accented", "count")
    return (unamb.join(lex, "anglicised", "left")
                 .withColumn("in_lexicon", F.coalesce(F.col("in_lexicon"), F.lit(False))))


def top_words(split: DataFrame, cutoff: int = K.ACCENT_MAP_SIZE, skip_identity: bool = False) -> DataFrame:
    """Op 76: rank the non-lexicon entries by (count desc, accented asc); rank <= cutoff repairs.

    Entries whose accent-stripped form is the word itself (``cœur``: no combining marks to drop)
    take ranks and, below the cut-off, make a correct word count as an issue, as in the original;
    ``skip_identity=True`` leaves them out."""
    candidates = split.where(~F.col("in_lexicon")).select("anglicised", "accented", "count")
    if skip_identity:
        candidates = candidates.where(F.col("anglicised") != F.col("accented"))
    ranked = with_ordinal(candidates, order=[F.col("count").desc(), F.col("accented").asc()],
                          out_col="vocab_rank")
    ranked = ranked.withColumn("vocab_rank", F.col("vocab_rank") + 1)
    return ranked.withColumn("in_map", F.col("vocab_rank") <= F.lit(cutoff))


def replacement_map(ranked: DataFrame) -> DataFrame:
    """(run, accented) for the entries inside the cut-off."""
    return ranked.where("in_map").select(F.col("anglicised").alias("run"), "accented")


def replace_accents(df: DataFrame, ranked: DataFrame, cutoff: int, text_col: str, out_col: str,
                    key: str = "pair_id") -> DataFrame:
    """Op 26: whole-word replacement of anglicised words by their accented spelling (all columns of
    ``df`` kept, ``out_col`` added). Rows may share a key or have none: see ``accent_changes``."""
    return _by_key(df, key, lambda part, keys: apply_changes(part, accent_changes(part, ranked, cutoff, text_col, keys), text_col, out_col, keys))


def _by_key(df: DataFrame, key: str, fn) -> DataFrame:
    """``fn(rows, key columns)`` over ``df``. Rows without a key are matched by their text alone, apart from
    the others (only if there are any), so a keyed table keeps its partitioning by the key."""
    if not df.where(F.col(key).isNull()).limit(1).count():
        return fn(df, [key])
    return fn(df.where(F.col(key).isNotNull()), [key]).unionByName(fn(df.where(F.col(key).isNull()), []))


def _digest(text_col: str) -> Column:
    return F.xxhash64(F.length(F.col(text_col)), F.col(text_col))


def accent_changes(df: DataFrame, ranked: DataFrame, cutoff: int, text_col: str, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """(keys, _digest, _changes): per key and text, map<run index, accented spelling> of the word runs that change.

    The text is cut into word / non-word runs (``posexplode``) and every run is looked up with a hash
    join; only the runs whose spelling changes are shuffled to be gathered per row, so the shuffle is
    proportional to the repairs, not to the text. What changes depends on the text alone, so rows that
    share a key are told apart by a digest of their text, and equal rows give one entry. The map has
    at most ``cutoff`` rows, so up to MAP_BROADCAST_MAX_ENTRIES it is broadcast and runs are never
    shuffled for the lookup (a shuffle by run would put every single-space run in one task). Beyond
    that bound only word runs take part in a shuffle join, where AQE's skew-join handling splits hot words.
    """
    runs = df.select(*keys, _digest(text_col).alias("_digest"),
                     F.posexplode_outer(F.regexp_extract_all(F.col(text_col), F.lit(T.WORD_RUNS), 0)).alias("run_pos", "run")) \
             .where("run_pos is not null")
    entries = replacement_map(ranked)
    if cutoff <= MAP_BROADCAST_MAX_ENTRIES:
        hits = runs.join(F.broadcast(entries), "run", "inner")
    else:
        hits = runs.where(F.col("run").rlike(r"^[\p{L}\p{N}_]")).join(entries, "run", "inner")
    changed = hits.where(F.col("accented") != F.col("run"))
    return changed.groupBy(*keys, "_digest").agg(
        F.map_from_entries(F.collect_set(F.struct("run_pos", "accented"))).alias("_changes"))


def apply_changes(df: DataFrame, changes: DataFrame, text_col: str, out_col: str, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Rebuild each row's text from its own runs with the changed runs swapped in; rows without
    changes keep their text (NULL stays NULL)."""
    joined = _join_by_text(df, changes, text_col, keys)
    runs = F.regexp_extract_all(F.col(text_col), F.lit(T.WORD_RUNS), 0)
    rebuilt = F.array_join(F.transform(runs, lambda r, i: F.coalesce(F.try_element_at("_changes", i), r)), "")
    return joined.withColumn(out_col, F.when(F.col("_changes").isNull(), F.col(text_col)).otherwise(rebuilt)) \
                 .drop("_changes")


def _join_by_text(df: DataFrame, found: DataFrame, text_col: str, keys: Sequence[str]) -> DataFrame:
    """Left join of ``found`` (keys, _digest, ...) to the rows: on the keys alone where there are any, the digest
    being a further condition, so a partitioning by the key is enough."""
    d, f = df.withColumn("_own", _digest(text_col)).alias("d"), found.alias("f")
    # written as an xor where there is a key, so that the digest doesn't become one of the join's keys
    same = F.col("d._own").bitwiseXOR(F.col("f._digest")) == 0 if keys else F.col("d._own") == F.col("f._digest")
    for k in keys:
        same = (F.col(f"d.{k}") == F.col(f"f.{k}")) & same
    new = [c for c in found.columns if c not in (*keys, "_digest")]
    return d.join(f, same, "left").select(*[F.col(f"d.`{c}`") for c in df.columns], *[F.col(f"f.{c}") for c in new])


def word_list_hits(df: DataFrame, words: DataFrame, text_col: str, out_col: str,
                   key: str = "pair_id", broadcast_words: bool | None = None) -> DataFrame:
    """Op 27: whitespace tokens of ``text_col`` that are in ``words`` (duplicates count)."""
    return word_lists_hits(df, {out_col: words}, text_col, key, broadcast_words)


def word_lists_hits(df: DataFrame, lists: dict[str, DataFrame], text_col: str, key: str = "pair_id",
                    broadcast_words: bool | None = None) -> DataFrame:
    """Op 27 for several word lists in one pass: tokens are exploded once, tagged by each list
    (broadcast when the list's rows and bytes are within the bound; else a Bloom filter drops the tokens that are
    in no list before the shuffle join), counted with one aggregate per key and text digest, and joined back with 0 for no hits.
    Equal rows under one key are counted together and divided by their number (their first tokens)."""
    tagged, long_lists = {}, []
    for name, words in lists.items():
        wl = words.select(F.col("word").alias("token")).distinct().withColumn(f"_in_{name}", F.lit(1))
        small = is_small(wl, LIST_BROADCAST_MAX_ROWS) if broadcast_words is None else broadcast_words
        tagged[name] = F.broadcast(wl) if small else wl
        long_lists += [] if small else [name]
    # what no list has is dropped before any list is shuffled to
    sieve = build(reduce(DataFrame.union, [w.select("token") for w in tagged.values()]).distinct()) if long_lists else None

    def count(part: DataFrame, keys: Sequence[str]) -> DataFrame:
        toks = part.select(*keys, _digest(text_col).alias("_digest"), F.posexplode_outer(T.whitespace_tokens(text_col)).alias("_pos", "token")) \
                   .where("_pos is not null")
        if sieve is not None:
            toks = keep_candidates(toks, sieve, always=F.col("_pos") == 0)
        for wl in tagged.values():
            toks = toks.join(wl, "token", "left")
        rows = F.count_if(F.col("_pos") == 0)
        counts = toks.groupBy(*keys, "_digest").agg(*[(F.count(f"_in_{n}") / rows).cast("long").alias(n) for n in lists])
        return _join_by_text(part, counts, text_col, keys)

    out = _by_key(df, key, count)
    return out.withColumns({name: F.coalesce(F.col(name), F.lit(0)).cast("long") for name in lists})
