"""A learned subword vocabulary (op 73): a unigram model of pieces, trained by EM over distinct words.

A word is written with ``MARK`` before it and cut into pieces; its likelihood is the sum, over all its
segmentations, of the product of their pieces' probabilities. Training reads the corpus once, for its distinct
words and their counts; then

1. every substring of up to ``LETTERS`` characters is counted (one exploded row a substring of a distinct word); the
   ``seeds`` best by count times length and all single characters are the first vocabulary;
2. an EM round is one Spark aggregate: a task runs forward-backward over the lattices of a block of words at once and adds up the
   expected counts of pieces as whole numbers (units of 2**-16), so that they don't depend on partitions. The
   likelihood doesn't fall from round to round while the vocabulary stays;
3. after ``rounds`` of them the pieces whose loss of likelihood is smallest go (a quarter at a time, never a
   single character), until ``size`` are left; more rounds follow.

A text's ids come from each word's best segmentation. Characters that training never saw are spelt in bytes,
whose 256 ids always exist: there is no unknown piece. Ties go to fewer pieces, then to the longer last piece.

The driver holds the vocabulary only (``seeds`` pieces and the distinct characters). Null and empty texts have
no words. An empty corpus gives a vocabulary without pieces.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import materialize, ship_package
from .prep import FIRST_WORD_ID, token_counts

MARK = "▁"
LETTERS = 8
UNIT = 1 << 16
KEEP = 0.75
#: Letters whose lattices are held at once; a longer word is alone.
BLOCK_LETTERS = 100_000
#: Ids: a byte b is FIRST_BYTE_ID + b, a piece follows the bytes.
FIRST_BYTE_ID = FIRST_WORD_ID
FIRST_PIECE_ID = FIRST_BYTE_ID + 256


@dataclass
class Subwords:
    """Pieces with log-probabilities, the likeliest first (ties by the piece), and the log-likelihood before each round
    with the vocabulary's size then."""
    scores: dict[str, float]
    history: list[tuple[int, float]] = field(default_factory=list)

    def ids(self) -> dict[str, int]:
        return {p: FIRST_PIECE_ID + i for i, p in enumerate(self.scores)}


def ordered(scores: dict[str, float]) -> dict[str, float]:
    return dict(sorted(scores.items(), key=lambda x: (-x[1], x[0])))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of the column ``text``: distinct white-space words, marked."""
    return token_counts(texts, ("text",)).select(F.concat(F.lit(MARK), "token").alias("word"), "n")


def seed_pieces(words: DataFrame, seeds: int) -> dict[str, float]:
    """The first vocabulary with log-probabilities by count."""
    starts = F.sequence(F.lit(1), F.length("word"))
    sizes = lambda i: F.sequence(F.lit(1), F.least(F.lit(LETTERS), F.length("word") - i + 1))
    cuts = F.flatten(F.transform(starts, lambda i: F.transform(sizes(i), lambda k: F.substr("word", i, k))))
    pieces = words.select(F.explode_outer(cuts).alias("piece"), "n").groupBy("piece").agg(F.sum("n").alias("n"))
    pieces = materialize(pieces.where("length(piece) = 1 or n > 1"), "subword-seeds")
    # the distinct characters, and a number of rows that the caller chose
    few = pieces.where("length(piece) = 1").union(pieces.where("length(piece) > 1").orderBy((F.col("n") * F.length("piece")).desc(), "piece").limit(seeds))
    counts = {r.piece: r.n for r in few.toLocalIterator()}
    total = sum(counts.values())
    return ordered({p: math.log(n / total) for p, n in counts.items()})


def ending(word: str, end: int, scores: dict[str, float]) -> list[tuple[int, str, float]]:
    """The pieces of the word's lattice that end at ``end``: begin, piece, log-probability."""
    return [(i, p, s) for i in range(max(0, end - LETTERS), end) if (s := scores.get(p := word[i:end])) is not None]


class Lattices:
    """The pieces as a trie over code points, and forward-backward over the lattices of many words at once."""

    def __init__(self, scores: dict[str, float]):
        self.pieces, nodes, self.node_piece = list(scores), {}, [-1]
        for number, piece in enumerate(self.pieces):
            at = 0
            for c in piece:
                key = at << 21 | ord(c)
                if key not in nodes:
                    nodes[key] = len(self.node_piece)
                    self.node_piece.append(-1)
                at = nodes[key]
            self.node_piece[at] = number
        self.keys, self.children = pa.array(nodes, pa.int64()), np.array(list(nodes.values()), np.int64)
        self.node_piece = np.array(self.node_piece, np.int64)
        self.scores = np.array([*scores.values(), -np.inf])  # the last is for what is no piece

    def found(self, codes: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The piece that begins at each code point with 1, 2, .. letters, -1 if none does or the word ends before."""
        out, at, node = np.full((len(codes), LETTERS), -1, np.int32), np.arange(len(codes)), np.zeros(len(codes), np.int64)
        for size in range(LETTERS):
            if size:
                more = left[at] > size
                at, node = at[more], node[more]
            child = pc.index_in(pa.array(node << 21 | codes[at + size]), value_set=self.keys)
            known = np.asarray(child.is_valid())
            at, node = at[known], self.children[child.drop_null().to_numpy()] if known.any() else node[:0]
            out[at, size] = self.node_piece[node]
        return out

    def laid_out(self, words: list[str]) -> Layout:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        reach = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0)) + 2), "right")
        offset = np.concatenate([[0], np.cumsum(reach[1:])])
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        place = np.arange(len(codes)) - np.repeat(begins, sizes)
        spot = offset[place] + np.repeat(rank, sizes)
        pieces = np.empty((LETTERS, len(codes)), np.int32)
        pieces[:, spot] = self.found(codes, np.repeat(sizes, sizes) - place).T
        return Layout(order, reach.tolist(), offset.tolist(), pieces, self.scores[pieces])

    def expected(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words' log-likelihoods, and for each word and piece of its lattice: word, piece, expected number."""
        at = self.laid_out(words)
        reach, offset, scores, longest = at.reach, at.offset, at.scores, len(at.reach) - 2
        forward = [np.zeros(len(words))]
        for end in range(1, longest + 1):
            n = reach[end]
            forward.append(_add([forward[i][:n] + scores[end - i - 1, offset[i]:offset[i] + n] for i in range(max(0, end - LETTERS), end)], n))
        backward = [np.zeros(n) for n in reach[:-1]]  # 0 where a word ends
        for begin in range(longest - 1, -1, -1):
            n, low = reach[begin + 1], offset[begin]
            ends = range(begin + 1, min(longest, begin + LETTERS) + 1)
            backward[begin][:n] = _add([scores[end - begin - 1, low:low + reach[end]] + backward[end] for end in ends], n)
        whole = backward[0]
        size, spot = np.nonzero(at.pieces >= 0)
        letters = np.array(reach[1:-1], np.int64)
        place = np.repeat(np.arange(longest), letters)[spot]
        rank = spot - np.array(offset, np.int64)[place]
        node = np.concatenate([[0], np.cumsum(reach[:-1])])  # where the nodes before each letter begin
        ways = np.concatenate(forward)[node[place] + rank] + scores[size, spot] + np.concatenate(backward)[node[place + size + 1] + rank]
        some = np.flatnonzero(whole[rank] > -np.inf)
        share = np.exp(ways[some] - whole[rank[some]])
        # a piece that the word has more than once is one row
        keys = rank[some] * len(self.pieces) + at.pieces[size[some], spot[some]]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        own = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        total = np.add.reduceat(share[order], own) if len(own) else share
        found = np.empty(len(words))
        found[at.order] = whole
        return found, at.order[keys[own] // max(1, len(self.pieces))], keys[own] % max(1, len(self.pieces)), total

    def segments(self, words: list[str]) -> list[list[int]]:
        """The numbers of the pieces of each word's best segmentation: what ``segment`` finds; each word has one."""
        at = self.laid_out(words)
        reach, offset, scores, longest = at.reach, at.offset, at.scores, len(at.reach) - 2
        best, used, last = [np.zeros(len(words))], [np.zeros(len(words), np.int64)], [np.zeros(0, np.int64)]
        for end in range(1, longest + 1):
            n = reach[end]
            top, few, size = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i in range(max(0, end - LETTERS), end):  # the longest last piece first: a tie keeps it
                score, many = best[i][:n] + scores[end - i - 1, offset[i]:offset[i] + n], used[i][:n] + 1
                better = (score > top) | (score == top) & (many < few)
                top, few, size = np.where(better, score, top), np.where(better, many, few), np.where(better, end - i, size)
            best.append(top)
            used.append(few)
            last.append(size)
        out: list[list[int]] = [[] for _ in words]
        # the pieces from each word's end to its begin, words that are as long at once
        waiting = [np.arange(reach[end + 1], reach[end]) for end in range(longest + 1)]
        order = at.order.tolist()
        for end in range(longest, 0, -1):
            rank = waiting[end]
            size = last[end][rank]
            piece = at.pieces[size - 1, np.array(offset)[end - size] + rank]
            for r, p in zip(rank.tolist(), piece.tolist()):
                out[order[r]].append(p)
            for s in np.unique(size).tolist():
                waiting[end - s] = np.concatenate([waiting[end - s], rank[size == s]])
        return [x[::-1] for x in out]


@dataclass
class Layout:
    """Words by falling length, letter by letter: the first letters of all words, then the second ones of those that
    have one, .. ``reach`` is the number of words with at least 0, 1, .. letters, ``offset`` where each letter's begin."""
    order: np.ndarray
    reach: list[int]
    offset: list[int]
    pieces: np.ndarray
    scores: np.ndarray


def _add(logs: list[np.ndarray], n: int) -> np.ndarray:
    """Log of the sum of the exponentials, of ``n`` numbers; a shorter array has none of the last ones."""
    top, total = np.full(n, -np.inf), np.zeros(n)
    for x in logs:
        np.maximum(top[:len(x)], x, out=top[:len(x)])
    top[top == -np.inf] = 0.0
    for x in logs:
        total[:len(x)] += np.exp(x - top[:len(x)])
    with np.errstate(divide="ignore"):
        return top + np.log(total)


def expected(word: str, scores: dict[str, float]) -> tuple[float, dict[str, float]]:
    """The word's log-likelihood and the expected number of each piece, by forward-backward over its lattice."""
    lattices = Lattices(scores)
    whole, _, pieces, totals = lattices.expected([word])
    return float(whole[0]), {lattices.pieces[p]: t for p, t in zip(pieces.tolist(), totals.tolist()) if t > 0}


def segment(word: str, scores: dict[str, float], without: str | None = None) -> tuple[float, list[str]]:
    """The best segmentation and its log-probability (minus infinity and nothing if there is none); ``without`` is a
    piece that may not be used."""
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    for end in range(1, len(word) + 1):
        # the highest score, then the fewest pieces, then the longest last piece
        best.append(max(((best[i][0] + s, best[i][1] - 1, -i) for i, p, s in ending(word, end, scores)
                         if p != without and best[i][0] > -math.inf), default=(-math.inf, 0, 0)))
    pieces, end = [], len(word)
    while end and best[end][0] > -math.inf:
        begin = -best[end][2]
        pieces.append(word[begin:end])
        end = begin
    return best[-1][0], pieces[::-1]


def _sums(scores: dict[str, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices, likelihood = Lattices(scores), 0
        totals = np.zeros(len(scores), np.int64)
        for batch in batches:
            words, counts = (c.to_pylist() for c in batch.columns)
            for low, high in _blocks(words):
                whole, word, piece, share = lattices.expected(words[low:high])
                n = np.array(counts[low:high], np.int64)
                likelihood += int((np.rint(np.where(whole > -np.inf, whole, 0.0) * UNIT).astype(np.int64) * n).sum())
                np.add.at(totals, piece, np.rint(share * UNIT).astype(np.int64) * n[word])
        some = np.flatnonzero(totals)
        names = ["", *[lattices.pieces[i] for i in some.tolist()]]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([likelihood, *totals[some].tolist()], pa.int64())], names=["piece", "n"])
    return run


def _blocks(words: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of words with about ``BLOCK_LETTERS`` letters; a longer word is alone."""
    low, size = 0, 0
    for i, word in enumerate(words):
        if i > low and size + len(word) > BLOCK_LETTERS:
            yield low, i
            low, size = i, 0
        size += len(word)
    if words:
        yield low, len(words)


def _round(words: DataFrame, scores: dict[str, float], history: list[tuple[int, float]]) -> tuple[dict[str, float], dict[str, float]]:
    """One EM round: new log-probabilities, and the expected counts they come from."""
    sums = words.mapInArrow(_sums(scores), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    counts = {r.piece: r.n / UNIT for r in sums.toLocalIterator()}
    history.append((len(scores), counts.pop("", 0.0)))
    # a character that no good segmentation uses keeps the least possible weight
    counts = {p: max(counts.get(p, 0.0), 1 / UNIT) for p in scores if counts.get(p, 0.0) > 0 or len(p) == 1}
    total = sum(counts.values())
    return ordered({p: math.log(n / total) for p, n in counts.items()}), counts


def _prune(scores: dict[str, float], counts: dict[str, float], size: int) -> dict[str, float]:
    """At least ``size`` and ``KEEP`` of the pieces: single characters, and those whose loss would cost most."""
    loss = {p: counts[p] * (s - segment(p, scores, without=p)[0]) for p, s in scores.items() if len(p) > 1}
    keep = max(size, int(KEEP * len(scores))) - (len(scores) - len(loss))
    kept = set(sorted(loss, key=lambda p: (-loss[p], p))[:max(0, keep)])
    return {p: s for p, s in scores.items() if len(p) == 1 or p in kept}


def train(texts: DataFrame, size: int, seeds: int | None = None, rounds: int = 2) -> Subwords:
    """A vocabulary of ``size`` pieces (more only if there are more distinct characters) learned from the column
    ``text`` of all rows."""
    ship_package(texts.sparkSession)
    # the table is small but a round works long on each word: files enough for every core
    parts = 2 * texts.sparkSession.sparkContext.defaultParallelism
    words = materialize(word_counts(texts).repartition(parts, "word"), "subword-words")
    model = Subwords(seed_pieces(words, seeds or 10 * size))
    while model.scores:
        for _ in range(rounds):
            model.scores, counts = _round(words, model.scores, model.history)
        if len(model.scores) <= max(size, sum(len(p) == 1 for p in model.scores)):
            break
        model.scores = _prune(model.scores, counts, size)
    return model


class Encoder:
    """Ids of texts; in the form that ``plugins.tokenize_with`` takes. Words are remembered within a task; the new ones of
    a batch are segmented together."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.known, self.lattices = scores, {}, Lattices(scores)
        self.number = {p: FIRST_PIECE_ID + i for i, p in enumerate(scores)}

    def word(self, word: str) -> list[int]:
        found = self.known.get(word)
        if found is None:
            found = []
            for run, seen in _runs(MARK + word, self.number):
                found += [self.number[p] for p in segment(run, self.scores)[1]] if seen else [FIRST_BYTE_ID + b for b in run.encode("utf-8", "surrogatepass")]
            if len(self.known) >= 200_000:
                self.known.clear()
            self.known[word] = found
        return found

    def text(self, text: str) -> list[int]:
        return [i for w in text.split() for i in self.word(w)]

    def learn(self, words: set[str]) -> None:
        """Remembers ``words``."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > 200_000:
            self.known.clear()
            new = list(words)
        whole = [w for w in new if MARK in self.number and all(c in self.number for c in w)]
        for low, high in _blocks(whole):
            found = self.lattices.segments([MARK + w for w in whole[low:high]])
            self.known.update(zip(whole[low:high], ([FIRST_PIECE_ID + i for i in ids] for ids in found)))

    def __call__(self, texts: list[str], max_len: int) -> list[list[int]]:
        from .prep import EOS_ID
        most = max_len - 1
        # a word has an id at least: those beyond the limit needn't be looked at
        split = [t.split(None, most)[:most] for t in texts] if most >= 0 else [t.split() for t in texts]
        self.learn({w for words in split for w in words})
        out = []
        for words in split:
            ids: list[int] = []
            for w in words:
                ids += self.known.get(w) or self.word(w)
                if 0 <= most <= len(ids):
                    break
            out.append(ids[:most] + [EOS_ID])
        return out

    def decode(self, ids: list[int]) -> str:
        names = list(self.scores)
        raw = b"".join(names[i - FIRST_PIECE_ID].encode() if i >= FIRST_PIECE_ID else bytes([i - FIRST_BYTE_ID]) for i in ids if i >= FIRST_BYTE_ID)
        return raw.decode("utf-8", "replace").replace(MARK, " ").strip(" ")


def _runs(word: str, number: dict[str, int]) -> Iterator[tuple[str, bool]]:
    """The word's longest runs of characters that the vocabulary has, and of those that it hasn't."""
    begin = 0
    for i in range(1, len(word) + 1):
        if i == len(word) or (word[i] in number) != (word[begin] in number):
            yield word[begin:i], word[begin] in number
            begin = i


def tokenize_subwords(records: DataFrame, model: Subwords, max_source_len: int = K.MAX_SOURCE_LEN,
                      max_target_len: int = K.MAX_TARGET_LEN) -> DataFrame:
    """Op 73 with a learned vocabulary: record_id, input_ids, labels, decoder_input_ids, as ``tokenize_records`` has
    them. Rows stay where they are."""
    from .plugins import tokenize_with
    from .prep import LANG_IDS, PAD_ID
    ship_package(records.sparkSession)
    return tokenize_with(records, partial(Encoder, model.scores), max_source_len, max_target_len, LANG_IDS, PAD_ID)
