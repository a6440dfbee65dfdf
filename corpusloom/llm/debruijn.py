"""Long repeated word spans by De Bruijn compaction.

The graph's edges are the windows of ``WINDOW`` words, each leading from its first to its last ``WINDOW - 1`` words.
Only the repeated part of it is ever built:

1. A window's anchor is the least of its ``ANCHOR``-word hashes (the leftmost of equal ones). Consecutive windows with the
   same anchor place are one run, a path of up to ``REACH`` edges, known by its anchor and a hash of its words. Equal windows have
   equal anchors, so a window can only be repeated in a run whose anchor stands in two documents: one
   pre-aggregated grouping by anchor drops all others. About 2 of 40 windows begin a run.
2. Where all runs of an anchor have the same words, the path doesn't branch: its source is the occurrence in the
   smallest document. Runs on which every occurrence goes on from one to the next (equal number, documents and
   places) are linked by a join in the source's coordinates and compact to one path, numbered by a running sum.
3. Where an anchor's runs differ, its edges are told apart one by one, in one copy of each distinct run, read from
   its source: an edge's smallest document is the least over the runs that hold it. Each run takes back a bit
   mask, so no copy is expanded.
4. A document's occurrences of a compacted path must lie side by side on one diagonal with its source; only then do
   they count as one span (else run by run). Spans and masks meet the text once more, which gives the words that are kept.

Hashes have 64 bits and are only compared below an equal 64-bit anchor hash. Hot passages are hot keys in
pre-aggregated sums and in plain joins with the copies on the large side, which Spark splits. What is
collected per row is one document's spans.

Edge cases: null text has no words; rows without id repeat nothing and lose nothing; rows with equal ids are the same
document, also with different texts, and never repeat each other. Fewer than ``WINDOW`` words: nothing goes. Long texts
are hashed in parts (8 bytes a word are held). Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.ordinal import with_running_total
from ..session import materialize
from .arrow import BASE, BASE_INVERSE, bound_batches, code_points, mix, powers, runs, span_hashes, text_blocks

WINDOW, ANCHOR = 50, 12
REACH = WINDOW - ANCHOR + 1
PART_CHARS, PART_WORDS = 300_000, 200_000
_SPACE = re.compile(r"[\x20\x09-\x0D]")


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of the texts, and the number of its text."""
    hashes, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, pieces in text_blocks(pa.array([p for t in texts for p in _parts(t or "")], pa.large_string()), PART_CHARS):
        values, begins = code_points(pieces)
        begin, end = runs(~((values == 32) | ((values >= 9) & (values <= 13))))
        hashes.append(span_hashes(values.astype(np.uint64) + np.uint64(1), begin, end))
        owner.append(np.bincount(np.searchsorted(begins, begin, "right") - 1, minlength=len(pieces)))
    of_part = np.repeat(np.arange(len(texts)), [sum(1 for _ in _parts(t or "")) for t in texts])
    return np.concatenate(hashes), np.repeat(of_part, np.concatenate(owner))


def _parts(text: str) -> Iterator[str]:
    at = 0
    while found := _SPACE.search(text, at + PART_CHARS):
        yield text[at:found.start()]
        at = found.end()
    yield text[at:]


class Sums:
    """Hashes of word sequences from running sums of a polynomial."""

    def __init__(self, hashes: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(BASE, len(hashes)))])
        self.back = powers(BASE_INVERSE, len(hashes) + 1)

    def of(self, begin: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.back[begin])


def anchored_runs(hashes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first word, windows, anchor, words' hash) of all runs, some words at a time. A run that such a part cuts
    is two runs: they differ from whole ones elsewhere, and so are told apart edge by edge."""
    first = np.searchsorted(owner, np.arange(owner[-1] + 1 if len(owner) else 0))
    for low in range(0, len(hashes) - WINDOW + 1, PART_WORDS):
        h, doc = (x[low:low + PART_WORDS + WINDOW - 1] for x in (hashes, owner))
        n, sums = len(h) - WINDOW + 1, Sums(h)
        anchor = sums.of(slice(0, len(h) - ANCHOR + 1), slice(ANCHOR, len(h) + 1))
        at, reach = np.arange(len(anchor)), 1
        while reach < REACH:
            step = min(reach, REACH - reach)
            left, right = at[:len(at) - step], at[step:]
            at, reach = np.where(anchor[left] <= anchor[right], left, right), reach + step
        whole = doc[:n] == doc[WINDOW - 1:]
        begin = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:n] != doc[:n - 1]) | (whole[1:] != whole[:-1])]))
        size = np.diff(np.append(begin, n))
        begin, size = begin[whole[begin]], size[whole[begin]]
        yield doc[begin], begin + low - first[doc[begin]], size, anchor[at[begin]], sums.of(begin, begin + size + WINDOW - 1)


def find_runs(docs: DataFrame) -> DataFrame:
    """(id, digest, place, n, anchor, h) of all runs of ``docs`` (id, digest, text)."""
    bound_batches(docs.sparkSession)
    schema = StructType([docs.schema["id"], *[StructField(c, LongType()) for c in ("digest", "place", "n", "anchor", "h")]])
    kind = to_arrow_type(docs.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_blocks(batch.column(2), PART_CHARS):
                for doc, place, n, anchor, h in anchored_runs(*word_hashes(texts)):
                    who = pa.array(doc + start)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(who).cast(kind), batch.column(1).take(who), *map(pa.array, (place, n, anchor.view(np.int64), h.view(np.int64)))], names=schema.names)

    return docs.where("id is not null").select("id", "digest", "text").mapInArrow(run, schema)


def find_edges(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, h, off, edge, id): the windows of each wanted run (id, digest, place, n, anchor, h), hashed in its source."""
    listed = wanted.groupBy("id", "digest").agg(F.collect_list(F.struct("place", "n", "anchor", "h")).alias("wanted"))
    schema = StructType([*[StructField(c, LongType()) for c in ("anchor", "h", "off", "edge")], docs.schema["id"]])
    kind = to_arrow_type(docs.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sums = Sums(word_hashes([batch.column(1)[i].as_py()])[0])
                asked = batch.column(2)[i].values
                place, n, anchor, h = (asked.field(c).to_numpy() for c in ("place", "n", "anchor", "h"))
                off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(place, n) + off
                edge = sums.of(at, at + WINDOW).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(anchor, n)), pa.array(np.repeat(h, n)), pa.array(off), pa.array(edge),
                                                  batch.column(0).take(pa.array(np.full(len(off), i))).cast(kind)], names=schema.names)

    return docs.join(listed, ["id", "digest"]).select("id", "text", "wanted").mapInArrow(run, schema)


def compact(paths: DataFrame) -> DataFrame:
    """``paths`` (anchor, id, digest, place of the source, n, and the sums copies, docs, places over all occurrences)
    with ``path``, the number of the compacted path. Two paths are linked if the source goes on from one to the next
    and so does every other occurrence."""
    before = paths.select("id", "digest", (F.col("place") + F.col("n")).alias("place"), F.col("copies").alias("b_copies"), F.col("docs").alias("b_docs"),
                          (F.col("places") + F.col("copies") * F.col("n")).alias("b_places"))
    linked = F.expr("b_copies <=> copies and b_docs <=> docs and b_places <=> places")
    heads = materialize(paths.join(before, ["id", "digest", "place"], "left").select(
        "anchor", "id", "digest", "place", "n", "copies", F.when(linked, 0).otherwise(1).cast("long").alias("head")), "debruijn-heads")
    numbered = with_running_total(heads, ["id", "digest", "place", "anchor"], "head", "heads_before")
    return numbered.select("anchor", "id", "digest", "place", "n", "copies", (F.col("heads_before") + F.col("head")).alias("path"))


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, paths, windows to remove): ``documents`` with their keys; compacted ``paths`` (path, id, place, n_words, copies);
    and for each document (id, digest) the spans (place, n, mask) of windows that also start in a smaller document."""
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("digest"), F.col(f"`{text_col}`").alias("text"))
    found = materialize(find_runs(docs), "debruijn-runs")
    anchors = found.groupBy("anchor").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.min("h").alias("h_low"), F.max("h").alias("h_high")) \
                   .where("least < most").select("anchor", "least", (F.col("h_low") != F.col("h_high")).alias("branches"))
    # sums are written before the joins: Spark splits a hot key only where both sides come straight from a shuffle
    anchors = materialize(anchors, "debruijn-anchors")
    marked = materialize(found.join(anchors, "anchor"), "debruijn-marked").dropDuplicates(["id", "digest", "place", "n", "anchor"])
    source = F.min(F.struct("id", "digest", "place")).alias("s")
    # paths that don't branch
    plain = materialize(marked.where("not branches").drop("branches", "h"), "debruijn-plain")
    paths = materialize(compact(plain.groupBy("anchor").agg(
        source, F.min("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.sum("place").alias("places"),
        F.sum(F.xxhash64("id", "digest").bitwiseAND(0x3FFFFFFF)).alias("docs")).select("anchor", "s.*", "n", "copies", "places", "docs")), "debruijn-paths")
    copies = plain.where("id > least").drop("least", "n").withColumnRenamed("place", "at").join(
        paths.select("anchor", "place", "n", "path"), "anchor")
    spans = copies.groupBy("id", "digest", "path", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.min("at").alias("low"), F.max(F.col("at") + F.col("n")).alias("high"), F.sum("n").alias("n"), F.collect_list(F.struct("at", "n")).alias("pieces"))
    none = F.lit(0).cast("long").alias("mask")
    side_by_side = F.array(F.struct(F.col("low").alias("place"), F.col("n"), none))
    spans = spans.select("id", "digest", F.when(F.expr("high - low = n"), side_by_side).otherwise(
        F.transform("pieces", lambda p: F.struct(p["at"].alias("place"), p["n"].alias("n"), none))).alias("spans"))
    # runs of anchors that branch: edge by edge
    forks = materialize(marked.where("branches"), "debruijn-forks")
    wanted = forks.groupBy("anchor", "h").agg(source, F.min("n").alias("n")).select("anchor", "h", "s.*", "n")
    edges = materialize(find_edges(docs, wanted), "debruijn-edges")
    least = materialize(edges.groupBy("anchor", "edge").agg(F.min("id").alias("least")), "debruijn-least")
    told = materialize(edges.select("anchor", "h", "off", "edge").join(least, ["anchor", "edge"]), "debruijn-told")
    told = materialize(told.groupBy("anchor", "h").agg(F.collect_set(F.struct("off", "least")).alias("edges")), "debruijn-edges-told")  # at most REACH
    bits = F.aggregate("edges", F.lit(0).cast("long"), lambda m, e: F.when(e["least"] < F.col("id"), m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), e["off"].cast("int")))).otherwise(m))
    masked = forks.join(told, ["anchor", "h"]).select("id", "digest", "place", bits.alias("mask")).where("mask != 0")
    masks = masked.select("id", "digest", F.array(F.struct("place", F.lit(0).cast("long").alias("n"), "mask")).alias("spans"))
    per_document = spans.union(masks).groupBy("id", "digest").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    whole = paths.groupBy("path").agg(F.min_by(F.struct("id", "place"), "place").alias("s"), F.sum("n").alias("n"), F.min("copies").alias("copies"))
    return docs, whole.select("path", "s.*", (F.col("n") + WINDOW - 1).alias("n_words"), "copies"), per_document


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, n_words, n_removed, kept_sha256 (of the words that are kept, joined by a space)."""
    docs, _, spans = repeated(df, id_col, text_col)
    rows = docs.join(spans, ["id", "digest"], "left").select("id", "spans", "text")
    bound_batches(df.sparkSession)
    schema = StructType([docs.schema["id"], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())])
    kind = to_arrow_type(docs.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_kept(text.as_py(), found.values if found.is_valid else None) for found, text in zip(batch.column(1), batch.column(2))]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))] if out else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), *columns], names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def covered(n_words: int, place: np.ndarray, n: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """For each word, whether one of the windows covers it: those from ``place`` on, ``n`` of them or the bits of ``mask``."""
    bits = np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    row, off = np.nonzero(bits)
    begin = np.concatenate([place[n > 0], place[row] + off])
    end = np.concatenate([(place + n)[n > 0] + WINDOW - 1, place[row] + off + WINDOW])
    change = np.bincount(begin, minlength=n_words + 1) - np.bincount(end, minlength=n_words + 1)
    return np.cumsum(change)[:n_words] > 0


def _kept(text: str | None, spans: pa.StructArray | None) -> tuple[int, int, str]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if spans is None:
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()
    gone = covered(len(words), *(spans.field(c).to_numpy() for c in ("place", "n", "mask")))
    return len(words), int(gone.sum()), hashlib.sha256(b" ".join(compress(words, ~gone))).hexdigest()
