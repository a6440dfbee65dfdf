"""Cross-tokenizer alignment with inverted pair bitmaps.

A text is tokenised twice: by a byte-level BPE vocabulary (A) and a sentence-piece model (B). The byte offsets
where tokens of both end cut them into groups; every A occurrence of a group is linked to every B occurrence.

1. Documents are taken in blocks of at most ``SLOTS`` rows; a row's place in its block is its slot. For each id
   pair a block keeps bitmaps over its slots: plane j has the documents whose number of links of the pair has
   bit j set. A plane is compressed: a list of slots, or a bit set once that is smaller. The planes' union is
   the pair's document bitmap (its population count: documents), their weighted population counts are links.
2. Blocks hold disjoint documents, so a pair's counts are the sums over its blocks' bitmaps: one aggregate by
   pair over two numbers a row; the bitmaps stay where they are.
3. The counts meet the blocks' bitmaps again (a join by pair; Spark splits a hot pair's blocks), and go home by
   block: the postings add each pair's count to the documents in its bitmaps. A block is a bounded group.

Tokens never reach over a single space between two characters that aren't white space (A begins a token there,
and no piece of B holds a space behind another character; models with such pieces are taken text by text). The
units between such spaces are aligned once and remembered while a task runs; a part of a long text at a time.

Edge cases: null and empty texts, and those that B doesn't spell out (its bytes differ, as for a literal
U+2581), have no tokens: zeros and an empty ``groups_sha256``. Special tokens' strings are plain text. Every row is
a document of its own, also if ids are null or rows repeat. Ties of a pair's count are all best. An unbroken
text is one unit, held whole with its tokens; a group's links are kept by distinct ids, never one by one, once there
are many. Empty tables give no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from ..operators.sizing import broadcast_if_small
from ..session import materialize
from .arrow import bound_batches, text_blocks

SLOTS = 4096
#: Words of a bit set over the slots, and so the longest list of slots.
DENSE = SLOTS // 16
#: (pair, slot) entries of a block, links of a group listed one by one, characters of a part, remembered units.
BLOCK_ENTRIES, LISTED_LINKS, PART_CHARS, REMEMBERED = 2_000_000, 100_000, 300_000, 400_000
#: A longer unit goes to the library whose time stays near linear in it.
LONG_UNIT = 1_000

_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the
    others, in order, for the letters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, vocabulary: str, model: bytes, pattern: str | None = None):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        self.whole_a = Tokenizer.from_str(vocabulary)
        self.whole_a.encode_special_tokens = True
        self.whole_a.no_truncation()
        self.whole_a.no_padding()
        letters, ids = byte_letters(), json.loads(vocabulary)["model"]["vocab"]
        self.bytes_a = np.empty(max(ids.values()) + 1, object)
        self.bytes_a[:] = b""
        for token, i in ids.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        # ids are merge ranks if every merge makes the next id; only then the faster library gives the same tokens
        merges = [m if isinstance(m, list) else m.split(" ") for m in json.loads(vocabulary)["model"]["merges"]]
        made = [ids["".join(m)] for m in merges]
        self.short_a = None
        if pattern and made == sorted(made):
            merged = set(made)
            ranked = {b: i for i, b in enumerate(self.bytes_a.tolist()) if i in merged or len(b) == 1}
            self.short_a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranked, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = np.empty(len(pieces), object)
        self.bytes_b[:] = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i)
                           else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.shift = np.uint64(max(1, len(pieces) - 1).bit_length())
        self.names_a, self.names_b = (np.array([[f"{i}{end}" for i in range(len(t))] for end in ends], object)
                                      for t, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;")))

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        short = self.short_a.encode_ordinary if self.short_a else None
        a = [short(" " + u) if short and len(u) <= LONG_UNIT else self.whole_a.encode(" " + u, add_special_tokens=False).ids for u in units]
        return a, self.b.encode(units, num_threads=1)


class Grown:
    """Numbers that are appended to, in an array that doubles."""

    def __init__(self, kind: type):
        self.room, self.n = np.empty(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            room = np.empty(2 * (self.n + len(values)), self.room.dtype)
            room[:self.n] = self.room[:self.n]
            self.room = room
        self.room[self.n:self.n + len(values)] = values
        self.n += len(values)

    def all(self) -> np.ndarray:
        return self.room[:self.n]


class Numbers(dict):
    """A number for each key, given when it is first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Units:
    """What alignment says of units: numbers, digest texts and linked pairs, in arrays that grow."""

    def __init__(self, tokenizers: Tokenizers):
        self.of = tokenizers
        self.clear()

    def clear(self) -> None:
        self.place = Numbers()
        self.characters = 0
        self.text: list[str] = []
        self.columns = {n: Grown(np.uint64 if n == "pair" else np.int64) for n in (*_COUNTS, "valid", "begin", "size", "pair", "links")}

    def make_room(self) -> None:
        """Forgets all units once they are many: between two texts or parts, when nobody holds their places."""
        if len(self.place) > REMEMBERED or self.characters > 20 * REMEMBERED:
            self.clear()

    def places(self, units: list[str]) -> np.ndarray:
        known = len(self.place)
        at = np.fromiter(map(self.place.__getitem__, units), np.int64, len(units))
        fresh = list(islice(self.place, known, None))
        for i in range(0, len(fresh), 50_000):
            self._align(fresh[i:i + 50_000])
        return at

    def column(self, name: str) -> np.ndarray:
        return self.columns[name].all()

    def _align(self, units: list[str]) -> None:
        t, n = self.of, len(units)
        ids_a, ids_b = t.encode(units)
        self.characters += sum(map(len, units))
        (a, unit_a), (b, unit_b) = _flat(ids_a), _flat(ids_b)
        wanted = [(" " + u).encode("utf-8", "surrogatepass") for u in units]
        size = np.fromiter(map(len, wanted), np.int64, n)
        valid = np.ones(n, bool)
        for ids, unit, lengths, names in ((a, unit_a, t.length_a, t.bytes_a), (b, unit_b, t.length_b, t.bytes_b)):
            if not (np.array_equal(np.bincount(unit, lengths[ids], minlength=n), size) and b"".join(names[ids].tolist()) == b"".join(wanted)):
                ends = np.cumsum(np.bincount(unit, minlength=n))
                valid &= [b"".join(names[ids[e - k:e]].tolist()) == w for e, k, w in zip(ends, np.bincount(unit, minlength=n), wanted)]
        self.columns["valid"].add(valid)
        a, unit_a, b, unit_b = a[valid[unit_a]], unit_a[valid[unit_a]], b[valid[unit_b]], unit_b[valid[unit_b]]
        end_a, end_b = np.cumsum(t.length_a[a]), np.cumsum(t.length_b[b])
        cut = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cut, end_a), np.searchsorted(cut, end_b)
        of_a, of_b = np.bincount(group_a, minlength=len(cut)), np.bincount(group_b, minlength=len(cut))
        first_a, first_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
        unit_g = unit_a[first_a] if len(cut) else np.zeros(0, np.int64)
        counts = (np.bincount(unit_a, minlength=n), np.bincount(unit_b, minlength=n), np.bincount(unit_g, minlength=n),
                  np.bincount(unit_g, of_a * of_b, minlength=n).astype(np.int64))
        for name, values in zip(_COUNTS, counts):
            self.columns[name].add(values)
        # links: for each A token all B tokens of its group; of a large group its distinct ids with their products
        large = of_a * of_b > LISTED_LINKS
        per = np.where(large[group_a], 0, of_b[group_a])
        at = np.repeat(first_b[group_a] - np.cumsum(per) + per, per) + np.arange(per.sum())
        pair = [(np.repeat(a, per).astype(np.uint64) << t.shift) | b[at].astype(np.uint64)]
        unit, links = [np.repeat(unit_a, per)], [np.ones(len(at), np.int64)]
        for g in np.flatnonzero(large):
            (ua, ca), (ub, cb) = (np.unique(x[f[g]:f[g] + k[g]], return_counts=True) for x, f, k in ((a, first_a, of_a), (b, first_b, of_b)))
            pair.append(((ua.astype(np.uint64) << t.shift)[:, None] | ub.astype(np.uint64)).ravel())
            links.append((ca[:, None] * cb).ravel())
            unit.append(np.full(len(pair[-1]), unit_g[g]))
        pair, unit, links = map(np.concatenate, (pair, unit, links))
        order = np.lexsort((pair, unit))
        pair, unit, links = pair[order], unit[order], links[order]
        first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (unit[1:] != unit[:-1])])) if len(pair) else np.zeros(0, np.int64)
        size = np.bincount(unit[first], minlength=n)
        self.columns["begin"].add(self.columns["pair"].n + np.cumsum(size) - size)
        self.columns["size"].add(size)
        self.columns["pair"].add(pair[first])
        self.columns["links"].add(np.add.reduceat(links, first) if len(first) else links)
        # a1,a2|b1; of every group, then cut by unit
        last_a, last_b = (np.diff(np.append(g, -1)) != 0 for g in (group_a, group_b))
        names = np.concatenate([t.names_a[last_a.astype(int), a], t.names_b[last_b.astype(int), b]])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        names, ends = names[order].tolist(), np.cumsum(counts[0] + counts[1]).tolist()
        self.text += ["".join(names[s:e])[:-1] for s, e in zip([0, *ends], ends)]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())), np.repeat(np.arange(len(ids)), sizes)


def parts(text: str, cuts: bool = True) -> Iterator[list[str]]:
    """The units of ``text``, those of about ``PART_CHARS`` characters at a time."""
    at = 0
    while cuts and (found := _BETWEEN.search(text, at + PART_CHARS)):
        yield _BETWEEN.split(text[at:found.start()])
        at = found.end()
    yield _BETWEEN.split(text[at:]) if cuts else [text]


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values, first)


def pack(pair: np.ndarray, slot: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Compressed planes of each pair, from rows ordered by (pair, slot): distinct pairs, documents, links, where
    each pair's planes begin (and the end), and all planes in 16-bit words: a plane is its number of documents,
    then its slots or, from more than ``DENSE`` on, a bit set."""
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    which = np.cumsum(np.concatenate([[0], pair[1:] != pair[:-1]]))
    n, depth = len(first), int(links.max()).bit_length()
    on = [np.flatnonzero((links >> j) & 1) for j in range(depth)]
    filled = np.stack([np.bincount(which[x], minlength=n) for x in on], axis=1)
    top = depth - np.argmax(filled[:, ::-1] > 0, axis=1)
    there = np.arange(depth) < top[:, None]
    sizes = np.where(there, 1 + np.minimum(filled, DENSE), 0).ravel()
    begin = np.concatenate([[0], np.cumsum(sizes)])
    words, plane = np.zeros(begin[-1], np.uint16), begin[:-1].reshape(n, depth)
    words[plane[there]] = filled[there]
    for j, x in enumerate(on):
        p, s = which[x], slot[x]
        rank = np.arange(len(x)) - (np.cumsum(filled[:, j]) - filled[:, j])[p]
        listed = filled[p, j] <= DENSE
        words[plane[p, j][listed] + 1 + rank[listed]] = s[listed]
        p, s = p[~listed], s[~listed]
        np.bitwise_or.at(words, plane[p, j] + 1 + (s >> 4), (1 << (s & 15)).astype(np.uint16))
    documents = np.diff(np.append(first, len(pair)))
    return pair[first], documents, filled @ (1 << np.arange(depth)), np.append(plane[:, 0], begin[-1]), words


def unpack(begin: np.ndarray, end: np.ndarray, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row, slot, weight) of every document bit, plane by plane, of rows whose planes are ``words[begin:end]``."""
    at, row, weight = begin.copy(), np.arange(len(begin)), 1
    while len(row):
        more = at < end[row]
        at, row = at[more], row[more]
        n = words[at].astype(np.int64)
        listed = np.where(n <= DENSE, n, 0)
        places = np.repeat(at + 1 - np.cumsum(listed) + listed, listed) + np.arange(listed.sum())
        yield np.repeat(row, listed), words[places].astype(np.int64), weight
        for i in np.flatnonzero(n > DENSE):
            slots = np.flatnonzero(np.unpackbits(words[at[i] + 1:at[i] + 1 + DENSE].view(np.uint8), bitorder="little"))
            yield np.full(len(slots), row[i]), slots, weight
        at, weight = at + 1 + np.minimum(n, DENSE), weight << 1


class Block:
    """The documents and pair bitmaps of one block while it is filled."""

    def __init__(self, units: Units):
        self.units = units
        self.empty()

    def empty(self) -> None:
        self.rows: list[tuple] = []
        self.keys, self.links, self.bad = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
        self.entries = 0

    def fits(self, n: int) -> bool:
        return len(self.rows) + n <= SLOTS and self.entries < BLOCK_ENTRIES

    def add(self, docs: list, texts: list[str | None]) -> None:
        """Takes in a run of documents with about ``PART_CHARS`` characters, or a longer one alone."""
        if len(texts) == 1 and len(texts[0] or "") > PART_CHARS:
            return self._add_long(docs[0], texts[0])
        u, slot = self.units, len(self.rows)
        u.make_room()
        units = [next(parts(t, u.of.cuts)) if t else [] for t in texts]
        at = u.places(list(chain.from_iterable(units)))
        size = np.fromiter(map(len, units), np.int64, len(units))
        owner, ends = np.repeat(np.arange(len(units)), size), np.cumsum(size)
        ok = (size > 0) & (np.bincount(owner[u.column("valid")[at] == 0], minlength=len(units)) == 0)
        totals = np.stack([np.bincount(owner, u.column(c)[at], minlength=len(units)) for c in _COUNTS], axis=1).astype(np.int64)
        names = list(map(u.text.__getitem__, at))
        for i, doc in enumerate(docs):
            text = ";".join(names[ends[i] - size[i]:ends[i]]) if ok[i] else ""
            self.rows.append((doc, *(totals[i].tolist() if ok[i] else [0] * 4), hashlib.sha256(text.encode()).hexdigest() if ok[i] else ""))
        good = ok[owner]
        self._count(slot + owner[good], at[good])

    def _add_long(self, doc: object, text: str) -> None:
        u, slot, totals, digest, ok = self.units, len(self.rows), np.zeros(4, np.int64), hashlib.sha256(), True
        for i, units in enumerate(parts(text, u.of.cuts)):
            u.make_room()
            at = u.places(units)
            ok = bool(u.column("valid")[at].all())
            if not ok:
                self.bad.append(slot)
                break
            totals += [u.column(c)[at].sum() for c in _COUNTS]
            digest.update((";" * (i > 0) + ";".join(map(u.text.__getitem__, at))).encode())
            self._count(np.full(len(at), slot), at)
        self.rows.append((doc, *(totals.tolist() if ok else [0] * 4), digest.hexdigest() if ok else ""))

    def _count(self, slot: np.ndarray, unit: np.ndarray) -> None:
        """Adds the pairs of units that occur in documents."""
        held, times = np.unique((slot.astype(np.uint64) << np.uint64(32)) | unit.astype(np.uint64), return_counts=True)
        slot, unit = held >> np.uint64(32), (held & np.uint64(0xFFFFFFFF)).astype(np.int64)
        size = self.units.column("size")[unit]
        at = np.repeat(self.units.column("begin")[unit] - np.cumsum(size) + size, size) + np.arange(size.sum())
        keys, links = summed((self.units.column("pair")[at] << np.uint64(12)) | np.repeat(slot, size), self.units.column("links")[at] * np.repeat(times, size))
        self.keys.append(keys)
        self.links.append(links)
        self.entries += len(keys)

    def close(self, number: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The block's bitmaps, merged over the parts of its texts, then its documents."""
        keys, links = summed(np.concatenate(self.keys), np.concatenate(self.links))
        slot = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        if self.bad:
            good = ~np.isin(slot, self.bad)
            keys, links, slot = keys[good], links[good], slot[good]
        if len(keys):
            pair, n_docs, n_links, begin, words = pack(keys >> np.uint64(12), slot, links)
            shift, planes = self.units.of.shift, pa.Array.from_buffers(pa.binary(), len(pair), [None, pa.py_buffer((begin * 2).astype(np.int32)), pa.py_buffer(words)])
            yield _batch(schema, len(pair), block=np.full(len(pair), number), a=(pair >> shift).astype(np.int32),
                         b=(pair & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int32), n_docs=n_docs, links=n_links, planes=planes)
        if self.rows:
            doc, *counts, digest = zip(*self.rows)
            yield _batch(schema, len(doc), block=np.full(len(doc), number), slot=np.arange(len(doc)), id=list(doc),
                         groups_sha256=list(digest), **dict(zip(_COUNTS, map(list, counts))))
        self.empty()


def _batch(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    made = [columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, schema)], schema=schema)


@lru_cache(maxsize=2)
def _units(vocabulary: str, model: bytes, pattern: str | None) -> Units:
    return Units(Tokenizers(vocabulary, model, pattern))


def encode(df: DataFrame, vocabulary: str, model: str, id_col: str = "doc_id", text_col: str = "text",
           pattern: str | None = None) -> DataFrame:
    """Rows of two kinds, by block: a document (``slot``, ``id``, counts, digest), or a pair of the block
    (``a``, ``b``, ``n_docs``, ``links``, ``planes``). ``vocabulary`` and ``model`` are files read on the driver."""
    with open(vocabulary, encoding="utf-8") as f:
        json_text = f.read()
    with open(model, "rb") as f:
        proto = f.read()
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((json_text, proto))
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = StructType([StructField("block", LongType()), StructField("slot", IntegerType()), docs.schema["id"],
                         *[StructField(c, LongType()) for c in _COUNTS], StructField("groups_sha256", StringType()),
                         StructField("a", IntegerType()), StructField("b", IntegerType()),
                         StructField("n_docs", LongType()), StructField("links", LongType()), StructField("planes", BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(*shared.value, pattern)
        block, number = Block(units), TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start, texts in text_blocks(batch.column(1), PART_CHARS):
                if not block.fits(len(texts)):
                    yield from block.close(number, arrow)
                    number += 1
                block.add(ids[start:start + len(texts)], texts)
        yield from block.close(number, arrow)
        units.clear()

    return docs.mapInArrow(run, schema)


def pair_counts(encoded: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_links, best): documents and links of each id pair, and whether it has the most documents
    of its A id's pairs. From written rows of ``encode``."""
    counts = materialize(encoded.where("a is not null").groupBy("a", "b").agg(
        F.sum("n_docs").alias("n_docs"), F.sum("links").alias("n_links")), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))  # a row for each id of the vocabulary at most
    return counts.join(broadcast_if_small(most, 1_000_000), "a").select("a", "b", "n_docs", "n_links", (F.col("n_docs") == F.col("most")).alias("best"))


def align(df: DataFrame, vocabulary: str, model: str, id_col: str = "doc_id", text_col: str = "text",
          pattern: str | None = None) -> DataFrame:
    """One row per row of ``df``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. ``pattern`` is
    the word pattern of ``vocabulary`` for the faster of two libraries that give the same tokens."""
    encoded = materialize(encode(df, vocabulary, model, id_col, text_col, pattern), "pair-bitmaps")
    counts = materialize(pair_counts(encoded), "pair-scores").select("a", "b", F.col("n_docs").alias("total"), "best")
    postings = encoded.where("a is not null").select("block", "a", "b", "planes").join(counts, ["a", "b"]).drop("a", "b")
    documents = encoded.where("slot is not null").select("block", "slot", "id", *_COUNTS, "groups_sha256")
    out = StructType([encoded.schema["id"], *[StructField(c, LongType()) for c in (*_COUNTS, "n_best", "count_sum")], encoded.schema["groups_sha256"]])
    scored = documents.unionByName(postings, allowMissingColumns=True).groupBy("block").applyInArrow(_score, out)
    return scored.withColumnRenamed("id", id_col)


def _score(rows: pa.Table) -> pa.Table:
    """The documents of one block, with the counts that its postings return."""
    postings = rows.filter(pc.is_null(rows["slot"]))
    documents = rows.filter(pc.is_valid(rows["slot"]))
    count_sum, n_best = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    for batch in postings.to_batches():
        planes = batch.column("planes").cast(pa.large_binary())
        _, ends, data = planes.buffers()
        ends = np.frombuffer(ends, np.int64)[planes.offset:planes.offset + len(planes) + 1]
        words = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view(np.uint16)
        ends = (ends - ends[0]) // 2
        total, best = batch.column("total").to_numpy(), batch.column("best").to_numpy(zero_copy_only=False).astype(np.int64)
        for row, slot, weight in unpack(ends[:-1], ends[1:], words):
            np.add.at(count_sum, slot, weight * total[row])
            np.add.at(n_best, slot, weight * best[row])
    slot = documents["slot"].to_numpy()
    made = {"n_best": n_best[slot], "count_sum": count_sum[slot]}
    return pa.table({c: made.get(c, documents[c] if c in documents.column_names else None)
                     for c in ("id", *_COUNTS, "n_best", "count_sum", "groups_sha256")})
