"""Toxicity scores from a lexicon matched by Levenshtein automata, with context windows.

Matching: the lexicon's terms form a trie. The Levenshtein automaton of distance 1 (0 for terms of fewer
than ``FUZZY_LENGTH`` letters) is intersected with the trie: a state is a set of (trie node, edits left)
and reads one character. The reachable sets are enumerated once into a transition table, so all words of
a block run through the table together, a character at a time, and most words die after a few.

Context: a hit inside double quotes on its line, or after a reporting word (said, wrote, called, ...)
within the window, counts as quotation, any other as plain. Each hit also sees how many further hits
stand in its window of ``WINDOW`` words. A document's features are the log-scaled counts of exact and
misspelled hits in plain and quoted context, distinct terms, the densest window, and hits per word;
a logistic regression turns them into a score.

Learning uses a bounded sample of labelled rows: at most about ``max_toxic`` toxic and ``max_clean`` other
documents, chosen by a hash of their id. Two thirds of them give the lexicon: words whose share among
toxic documents is significantly larger (signed log-likelihood ratio of at least ``MIN_EVIDENCE``); the rest fit
the regression, so it sees the lexicon as new documents will. The lexicon used for scoring is then learned
again, the same way, from the whole sample. Scores read nothing but the text.

Edge cases: null and empty texts have no hits and get the regression's base score; with no labelled rows the
lexicon is ``SEED_TERMS`` and the weights are ``DEFAULT_WEIGHTS``. Rows are passed through one by one; repeated
rows get equal scores; several labels of one id count as toxic if any is.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField

from ..session import materialize
from .arrow import append_columns, bound_batches, character_kinds, code_points, hash_share, runs, text_blocks

WINDOW = 10
FUZZY_LENGTH = 5
MIN_LENGTH, MAX_LENGTH = 3, 24
MIN_EVIDENCE = 20.0
FEATURES = ("plain_exact", "plain_fuzzy", "quoted_exact", "quoted_fuzzy", "terms", "densest", "per_word")

#: Terms that are in the lexicon whatever the labels say, and words that report speech.
SEED_TERMS = ["idiot", "moron", "stupid", "loser", "pathetic", "scum", "worthless", "disgusting", "clown", "trash",
              "imbecile", "dumbass", "bastard", "retard"]
REPORTING = ["said", "says", "wrote", "writes", "called", "calls", "quoted", "quote", "word", "term", "dit", "sagte", "dijo"]
#: Base score, then a weight for each of FEATURES; used when there is nothing to learn from.
DEFAULT_WEIGHTS = [-3.0, 3.0, 1.5, 0.5, 0.2, 0.5, 0.5, 1.0]


class Matcher:
    """Transition table of the lexicon trie intersected with its terms' Levenshtein automata."""

    def __init__(self, terms: list[str]):
        self.terms = sorted(set(terms))
        letters = sorted({c for t in self.terms for c in t})
        self.kind = np.zeros(0x110000, np.min_scalar_type(len(letters)))
        code = {c: i + 1 for i, c in enumerate(letters)}
        for c, i in code.items():
            self.kind[ord(c)] = i
        children: list[dict[int, int]] = [{}, {}]  # roots: terms matched exactly, terms matched with an edit
        ends: dict[int, int] = {}
        for i, t in enumerate(self.terms):
            node = int(len(t) >= FUZZY_LENGTH)
            for c in t:
                if code[c] not in children[node]:
                    children[node][code[c]] = len(children)
                    children.append({})
                node = children[node][code[c]]
            ends[node] = i

        def closed(states) -> frozenset:
            best: dict[int, int] = {}
            todo = list(states)
            while todo:
                node, left = todo.pop()
                if best.get(node, -1) >= left:
                    continue
                best[node] = left
                if left:  # a letter of the term is missing
                    todo += [(child, left - 1) for child in children[node].values()]
            return frozenset(best.items())

        def step(states: frozenset, c: int) -> frozenset:
            out = []
            for node, left in states:
                if c in children[node]:
                    out.append((children[node][c], left))
                if left:  # another letter, or one too many
                    out.append((node, left - 1))
                    out += [(child, left - 1) for child in children[node].values()]
            return closed(out)

        start = closed([(0, 0), (1, 1)])
        number, table, accept = {frozenset(): 0, start: 1}, [[0] * (len(letters) + 1)], [-1, -1]
        todo, edits = [start], [0, 0]
        while todo:
            states = todo.pop(0)
            used = {c for node, _ in states for c in children[node]}
            other = step(states, 0)
            row = []
            for c in range(len(letters) + 1):
                after = step(states, c) if c in used else other
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                    best = min(((int(not left and len(self.terms[ends[node]]) >= FUZZY_LENGTH), ends[node]) for node, left in after if node in ends),
                               default=(0, -1))
                    edits.append(best[0])
                    accept.append(best[1])
                row.append(number[after])
            table.append(row)
        self.table, self.accept, self.edits = np.array(table, np.int32), np.array(accept, np.int32), np.array(edits, np.int8)

    def match(self, cps: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching words, their terms and their edits (0 or 1)."""
        words, state = np.arange(len(begins)), np.ones(len(begins), np.int32)
        found, at = [], 0
        while len(words):
            state = self.table[state, self.kind[cps[begins[words] + at]]]
            at += 1
            done = begins[words] + at == ends[words]
            found.append((words[done], state[done]))
            go = ~done & (state > 0)
            words, state = words[go], state[go]
        w, s = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int32) for i in (0, 1))
        hit = self.accept[s] >= 0
        order = np.argsort(w[hit])
        return w[hit][order], self.accept[s[hit]][order], self.edits[s[hit]][order]


def words_of(texts: list[str | None]):
    """Code points of the lower-cased texts, words (letters and digits, with @ $ * ! inside), their documents."""
    cps, starts = code_points([(t or "").lower() for t in texts])
    plain = character_kinds()[cps] > 0
    inner = np.isin(cps, [ord(c) for c in "@$*!"])
    inner[1:-1] &= plain[:-2] & plain[2:]
    begins, ends = runs(plain | inner)
    return cps, begins, ends, np.searchsorted(starts, begins, "right") - 1


def features(texts: list[str | None], matcher: Matcher, reporting: Matcher) -> np.ndarray:
    """(documents, FEATURES) of a block of texts."""
    cps, begins, ends, document = words_of(texts)
    n = len(texts)
    out = np.zeros((n, len(FEATURES)))
    hit, term, edits = matcher.match(cps, begins, ends)
    if not len(hit):
        return out
    quotes = np.flatnonzero(np.isin(cps, [0x22, 0xAB, 0xBB, 0x201C, 0x201D, 0x201E]))
    lines = np.flatnonzero(cps == 10)
    line = np.searchsorted(lines, begins[hit]) - 1
    quotes_at = np.searchsorted(quotes, begins[hit])
    open_before = quotes_at - np.searchsorted(quotes, lines[line])
    close_after = np.searchsorted(quotes, lines[line + 1]) - quotes_at
    said, _, said_edits = reporting.match(cps, begins, ends)
    said = said[said_edits == 0]
    before = np.searchsorted(said, hit) - 1
    reported = np.zeros(len(hit), bool)
    if len(said):
        last = said[np.maximum(before, 0)]
        reported = (before >= 0) & (hit - last <= WINDOW // 2) & (document[last] == document[hit])
    quoted = (open_before % 2 == 1) & (close_after > 0) | reported
    owner = document[hit]
    for i, (q, e) in enumerate([(False, 0), (False, 1), (True, 0), (True, 1)]):
        out[:, i] = np.log1p(np.bincount(owner[(quoted == q) & (edits == e)], minlength=n))
    pairs = np.unique(owner.astype(np.int64) * len(matcher.terms) + term)
    out[:, 4] = np.log1p(np.bincount(pairs // len(matcher.terms), minlength=n))
    near = np.searchsorted(hit, hit + WINDOW, "right") - np.arange(len(hit))  # hits from this one to the window's end
    last_own = np.searchsorted(owner, owner, "right") - np.arange(len(hit))
    np.maximum.at(out[:, 5], owner, np.log1p(np.minimum(near, last_own)))
    words = np.bincount(document, minlength=n)
    out[:, 6] = np.minimum(np.bincount(owner, minlength=n) / np.maximum(words, 1) * 20.0, 1.0)
    return out


@dataclass
class Model:
    terms: list[str]
    weights: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -30, 30)))


_MATCHERS: dict[tuple, Matcher] = {}


def matcher_for(terms: list[str]) -> Matcher:
    """The matcher of a lexicon; built once per Python process."""
    key = tuple(terms)
    if key not in _MATCHERS:
        if len(_MATCHERS) > 4:
            _MATCHERS.clear()
        _MATCHERS[key] = Matcher(terms)
    return _MATCHERS[key]


def score_toxicity(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``df`` with ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on) and ``n_hits`` (plain exact hits). No shuffle;
    the broadcast tables are bounded by the lexicon's size."""
    shared = df.sparkSession.sparkContext.broadcast((model, matcher_for(model.terms), matcher_for(REPORTING)))
    fields = [StructField("score", DoubleType()), StructField("predicted", LongType()), StructField("n_hits", LongType())]

    def run(texts):
        m, lexicon, reporting = shared.value
        x = features(texts, lexicon, reporting)
        s = m.score(x)
        return {"score": s, "predicted": (s >= threshold).astype(np.int64), "n_hits": np.round(np.expm1(x[:, 0])).astype(np.int64)}

    return append_columns(df, text_col, fields, run)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_toxic: int = 3000, max_clean: int = 12000, max_terms: int = 400) -> Model:
    """Learns the lexicon and the weights from a bounded sample of the labelled rows of ``docs``."""
    spark = docs.sparkSession
    bound_batches(spark)
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()) \
                   .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if not counts.get(1) or not counts.get(0):
        return Model(sorted(SEED_TERMS), DEFAULT_WEIGHTS)
    share = F.when(F.col("toxic") == 1, hash_share("id", max_toxic / counts[1])).otherwise(hash_share("id", max_clean / counts[0]))
    chosen = F.broadcast(marked.where(share))  # about max_toxic + max_clean rows of two numbers
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id") \
               .select("id", "text", "toxic", (F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(3)) > 0).alias("for_lexicon"))
    sample = materialize(rows, "toxicity-sample")

    def count(batches):
        seen = (Counter(), Counter())
        for batch in batches:
            toxic = batch.column(1).to_pylist()
            for start, texts in text_blocks(batch.column(0)):
                cps, begins, ends, document = words_of(texts)
                size = ends - begins
                fit = np.flatnonzero((size >= MIN_LENGTH) & (size <= MAX_LENGTH))
                joined = cps.tobytes().decode("utf-32-le", "surrogatepass")
                b, e, d = begins[fit].tolist(), ends[fit].tolist(), document[fit]
                cuts = np.searchsorted(d, np.arange(len(texts) + 1)).tolist()
                for i in range(len(texts)):
                    seen[toxic[start + i]].update({joined[x:y] for x, y in zip(b[cuts[i]:cuts[i + 1]], e[cuts[i]:cuts[i + 1]])})
        for word_counts, column in zip(seen, ("clean", "toxic")):
            words = list(word_counts)
            for i in range(0, len(words), 20_000):
                part = words[i:i + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.string())] + [pa.array([word_counts[w] if column == c else 0 for w in part], pa.int64()) for c in ("toxic", "clean")],
                    names=["word", "toxic", "clean"])

    def lexicon(part: DataFrame) -> list[str]:
        n = {r["toxic"]: float(r["count"]) for r in part.groupBy("toxic").count().collect()}
        terms: list[str] = []
        if n.get(1) and n.get(0):
            words = part.select("text", "toxic").mapInArrow(count, "word string, toxic long, clean long") \
                        .groupBy("word").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
            base, a, b = n[1] / (n[1] + n[0]), F.col("a"), F.col("b")
            ratio = 2 * (F.when(a > 0, a * F.log(a / ((a + b) * base))).otherwise(0) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - base)))).otherwise(0))
            strong = words.where((a / n[1] > 3 * b / n[0]) & (a >= 3) & ~F.col("word").rlike("^[0-9]+$")) \
                          .withColumn("evidence", ratio).where(F.col("evidence") >= MIN_EVIDENCE)
            terms = [r["word"] for r in strong.orderBy(F.desc("evidence"), "word").limit(max_terms).collect()]
        return sorted({*terms, *SEED_TERMS})

    terms = lexicon(sample.where("for_lexicon"))
    shared = spark.sparkContext.broadcast((matcher_for(terms), matcher_for(REPORTING)))

    def measure(batches):
        for batch in batches:
            for start, texts in text_blocks(batch.column(0)):
                x = features(texts, *shared.value)
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "toxic", "x"])

    # one short vector for each row of the bounded sample
    fitted = sample.where("not for_lexicon").select("text", "id", "toxic").mapInArrow(measure, "id long, toxic int, x array<double>") \
                   .groupBy("x", "toxic").count().collect()
    return Model(lexicon(sample), _regress(sorted((r["x"], r["toxic"], r["count"]) for r in fitted)))


def _regress(rows: list[tuple[list[float], int, int]], ridge: float = 0.3) -> list[float]:
    """Weights of a ridge logistic regression, by Newton's method."""
    if len({y for _, y, _ in rows}) < 2:
        return DEFAULT_WEIGHTS
    x = np.array([[1.0, *r[0]] for r in rows])
    y, n = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[0] = 1e-3
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + np.diag(keep), x.T @ (n * (p - y)) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return [round(float(v), 9) for v in w]
