"""A learned annotator (op 18, with 15-17): a hidden Markov tagger over token arrays.

A token is its shape (``a`` small, ``A`` capital, ``S`` capital at the start, ``0`` digit, ``.`` mark) and its small
letters. Its emission class is the deepest node it reaches in a trie of suffixes: the whole word, else its last
4, 3, 2, 1, 0 letters. A node exists if it has ``min_share`` of its language's tokens (so a level has at most
``1 / min_share`` nodes a shape, which bounds the model); the empty suffix of each shape always does.

Training is Baum-Welch: the model starts from the suffix and capital rules of the default annotator, and every
round is one Spark aggregate over all texts. A task runs forward-backward over its token arrays and adds up
expected counts as whole numbers (units of 2**-20), so sums don't depend on how rows are partitioned. The
log-posterior (likelihood with a Dirichlet prior of ``smoothing``) never falls from round to round. Tags are counted
by Viterbi.

Null texts have missing counts, texts without tokens zeros; a language without any token can't be learned from
and keeps the start model. Ties of Viterbi go to the tag that comes first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package

TAGS = ("verb", "noun", "entity", "other")
TOKEN_RE = r"(?U)\w+(?:['’-]\w+)*|[^\w\s]"
LETTERS = 4
UNIT = 1 << 20
#: Tokens whose arrays are held at once; a longer text is alone.
BLOCK_TOKENS = 400_000

#: Endings of the default annotator's rules.
ENDINGS = {"verb": ("ing", "ed", "er"), "noun": ("tion", "ment", "ness")}


@dataclass
class Hmm:
    """One language's model. ``classes`` numbers the trie's nodes; rows of ``emit`` and ``trans`` belong to tags."""
    classes: dict[str, int]
    start: np.ndarray
    trans: np.ndarray
    emit: np.ndarray

    def classes_of(self, tokens: list[str], known: dict[str, int]) -> list[int]:
        """``class_of`` each; ``known`` remembers them from batch to batch."""
        if len(known) > 200_000:
            known.clear()
        out = []
        for token in tokens:
            found = known.get(token)
            if found is None:
                found = known[token] = self.class_of(token)
            out.append(found)
        return out

    def class_of(self, token: str) -> int:
        shape, word = token[0], token[1:]
        found = self.classes.get(f"{shape}^{word}")
        size = min(LETTERS, len(word))
        while found is None and size >= 0:
            found = self.classes.get(shape + word[len(word) - size:])
            size -= 1
        return self.classes[""] if found is None else found


@dataclass
class Tagger:
    """Models by language, and the log-posterior of each round."""
    models: dict[str, Hmm]
    history: list[float] = field(default_factory=list)


def token_forms(text: Column) -> Column:
    """Array of tokens as shape and small letters; null for a null text."""
    def form(token: Column, place: Column) -> Column:
        first = F.substring(token, 1, 1)
        shape = F.when(first.rlike(r"\p{Lu}"), F.when(place == 0, "S").otherwise("A")).when(first.rlike(r"\p{L}"), "a") \
                 .when(first.rlike(r"\p{N}"), "0").otherwise(".")
        return F.concat(shape, F.lower(token))
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN_RE), F.lit(0)), form)


def _nodes(token: Column) -> Column:
    """All trie nodes of a token form."""
    shape, word = F.substring(token, 1, 1), F.substring(token, 2, 1 << 30)
    tails = [F.concat(shape, F.right(word, F.lit(n))) for n in range(1, LETTERS + 1)]
    return F.array_distinct(F.array(shape, *tails, F.concat(shape, F.lit("^"), word)))


def suffix_trie(texts: DataFrame, min_share: float) -> dict[str, dict[str, int]]:
    """Nodes of each language's trie with their tokens. ``texts``: lang, tokens."""
    words = texts.select("lang", F.explode_outer("tokens").alias("token")).where("token is not null").groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))
    nodes = words.select("lang", F.explode(_nodes(F.col("token"))).alias("node"), "n").groupBy("lang", "node").agg(F.sum("n").alias("n"))
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))  # a row per language
    kept = nodes.join(F.broadcast(total), "lang").where((F.length("node") == 1) | ((F.col("n") >= 2) & (F.col("n") >= min_share * F.col("total"))))
    found: dict[str, dict[str, int]] = {}
    for r in kept.select("lang", "node", "n").toLocalIterator():
        found.setdefault(r.lang, {})[r.node] = r.n
    return found


def start_model(nodes: dict[str, int], endings: dict[str, tuple[str, ...]] = ENDINGS) -> Hmm:
    """The rules as a model: a class with a tag's ending, or a capital's shape, weighs for its tag."""
    names = sorted({*nodes, ""})
    emit = np.ones((len(TAGS), len(names)))
    for c, name in enumerate(names):
        tags = [t for t, ends in endings.items() if name[:1] in ("a", "A", "S") and name[1:].endswith(ends)]
        if name[:1] == "A":
            tags = ["entity"]
        weight = np.array([8.0 if t in tags or not tags and t == "other" else 1.0 for t in TAGS])
        emit[:, c] = weight * (nodes.get(name, 0) + 1)
    even = np.full(len(TAGS), 1 / len(TAGS))
    stay = np.full((len(TAGS), len(TAGS)), 1 / len(TAGS))
    return Hmm({n: i for i, n in enumerate(names)}, even, stay, emit / emit.sum(1, keepdims=True))


class Steps:
    """Texts' tokens, laid end to end, in another order: the longest texts' first tokens first, then all second tokens, ..
    ``spot`` is each token's new place; those of step t are ``at[t]`` .. ``at[t + 1]``, in the order of their texts, so a
    token's text is as far from the step's begin in every step."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        alive = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), "left")
        at = np.concatenate([[0], np.cumsum(alive)])
        rank = np.empty(len(lengths), np.int64)
        rank[order] = np.arange(len(lengths))
        place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.spot = at[place] + np.repeat(rank, lengths)
        self.at, self.longest = at.tolist(), len(alive)
        #: the token before each token of step 1 on
        self.before = np.arange(at[min(1, len(alive))], at[-1]) - np.repeat(alive[:-1], alive[1:])


def _through(rows: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """matrix.T @ rows, summed in a fixed order whatever the number of columns."""
    out = rows[0] * matrix[0][:, None]
    for j in range(1, matrix.shape[0]):
        out += rows[j] * matrix[j][:, None]
    return out


def _passes(hmm: Hmm, classes: np.ndarray, steps: Steps) -> tuple[np.ndarray, Callable[[int, int], np.ndarray], np.ndarray]:
    """``forward_backward`` of tokens in the order of ``steps``, the last axis theirs. The joint ones are made for a tag and
    its follower when asked for, of the tokens ``steps.before``."""
    likely = np.ascontiguousarray(hmm.emit[:, classes])
    alpha, beta, scale, at = np.empty_like(likely), np.ones_like(likely), np.ones(len(classes)), steps.at
    for t in range(steps.longest):
        low, high = at[t], at[t + 1]
        a = likely[:, low:high] * (_through(alpha[:, at[t - 1]:at[t - 1] + high - low], hmm.trans) if t else hmm.start[:, None])
        scale[low:high] = a.sum(0)
        alpha[:, low:high] = a / scale[low:high]
    onward = np.empty_like(likely)
    for t in range(steps.longest - 1, 0, -1):
        low, high = at[t], at[t + 1]
        onward[:, low:high] = likely[:, low:high] * beta[:, low:high] / scale[low:high]
        beta[:, at[t - 1]:at[t - 1] + high - low] = _through(onward[:, low:high], hmm.trans.T)
    after = onward[:, at[min(1, steps.longest)]:]
    return alpha * beta, lambda i, j: alpha[i, steps.before] * hmm.trans[i, j] * after[j], np.log(scale)


def forward_backward(hmm: Hmm, classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts' tokens laid end to end: each token's tag probabilities, each token's and its follower's joint ones
    (nothing for a last token), and each token's share of the log-likelihood."""
    steps = Steps(lengths)
    each, joint, share = _passes(hmm, _dealt(classes, steps), steps)
    whole = np.zeros((len(classes), *hmm.trans.shape))
    for i, j in np.ndindex(hmm.trans.shape):
        whole[steps.before, i, j] = joint(i, j)
    return each.T[steps.spot], whole[steps.spot], share[steps.spot]


def _dealt(classes: np.ndarray, steps: Steps) -> np.ndarray:
    out = np.empty_like(classes)
    out[steps.spot] = classes
    return out


def viterbi(hmm: Hmm, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The likeliest tags of the texts' tokens laid end to end."""
    steps = Steps(lengths)
    at = steps.at
    with np.errstate(divide="ignore"):
        likely, trans, start = np.ascontiguousarray(np.log(hmm.emit)[:, _dealt(classes, steps)]), np.log(hmm.trans), np.log(hmm.start)
    back, best = np.zeros(likely.shape, np.int8), np.empty_like(likely)
    for t in range(steps.longest):
        low, high = at[t], at[t + 1]
        if t == 0:
            best[:, low:high] = start[:, None] + likely[:, low:high]
            continue
        before = best[:, at[t - 1]:at[t - 1] + high - low]
        top, place = before[0] + trans[0][:, None], np.zeros((len(trans), high - low), np.int8)
        for j in range(1, len(trans)):  # a tie keeps the tag that comes first
            ways = before[j] + trans[j][:, None]
            place[ways > top] = j
            np.maximum(top, ways, out=top)
        back[:, low:high], best[:, low:high] = place, top + likely[:, low:high]
    out = best.argmax(0) if len(classes) else np.zeros(0, np.int64)  # a last token's; others' follow from their followers'
    for t in range(steps.longest - 1, 0, -1):
        low, high = at[t], at[t + 1]
        out[at[t - 1]:at[t - 1] + high - low] = back[out[low:high], np.arange(low, high)]
    return out[steps.spot]


def _blocks(column: pa.Array, model: Hmm, remembered: dict[str, int] | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, classes, lengths) of runs of rows with about ``BLOCK_TOKENS`` tokens."""
    lengths = np.array(column.fill_null([]).value_lengths(), np.int64) if len(column) else np.zeros(0, np.int64)
    coded = column.flatten().dictionary_encode()
    known = np.array(model.classes_of(coded.dictionary.to_pylist(), {} if remembered is None else remembered), np.int64)
    classes = known[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + BLOCK_TOKENS, "right")))
        yield at, end, classes[before:ends[end - 1]], lengths[at:end]
        at = end


def _expected(models: dict[str, Hmm]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's expected counts: rows (lang, slot, one number a tag). Slot 0 has the first tags, 1 the log-likelihood,
    2 .. the transitions from each tag, then a slot for each class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags = len(TAGS)
        totals = {lang: np.zeros((2 + tags + len(m.classes), tags), np.int64) for lang, m in models.items()}
        known: dict[str, dict[str, int]] = {lang: {} for lang in models}
        for batch in batches:
            for lang, model in models.items():
                rows = batch.filter(pc.equal(batch.column(0), lang))
                for _, _, classes, lengths in _blocks(rows.column(1), model, known[lang]):
                    if not len(classes):
                        continue
                    steps = Steps(lengths)
                    classes = _dealt(classes, steps)
                    each, joint, share = _passes(model, classes, steps)
                    total, whole = totals[lang], lambda x: np.rint(x * UNIT).astype(np.int64)
                    each = whole(each)
                    total[0] += each[:, :steps.at[1]].sum(1)
                    total[1, 0] += whole(share).sum()
                    for i, j in np.ndindex(tags, tags):
                        total[2 + i, j] += whole(joint(i, j)).sum()
                    for tag in range(tags):
                        np.add.at(total[:, tag], 2 + tags + classes, each[tag])
        for lang, total in totals.items():
            slot = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot), pa.string()), pa.array(slot), *[pa.array(total[slot, j]) for j in range(tags)]],
                                             names=["lang", "slot", *TAGS])
    return run


def train(texts: DataFrame, rounds: int = 4, min_share: float = 1e-4, smoothing: float = 0.1) -> Tagger:
    """A tagger learned from all of ``texts`` (lang, text). The model (trie nodes x tags) is held on the driver and sent to
    the tasks; ``min_share`` bounds it."""
    ship_package(texts.sparkSession)
    tokens = texts.where("text is not null and lang is not null").select("lang", token_forms(F.col("text")).alias("tokens"))
    # written once: the trie and every round read them
    tokens = materialize(tokens, "tagger-tokens")
    tagger = Tagger({lang: start_model(nodes) for lang, nodes in sorted(suffix_trie(tokens, min_share).items())})
    for _ in range(rounds if tagger.models else 0):
        schema = "lang string, slot long, " + ", ".join(f"{t} long" for t in TAGS)
        sums = tokens.mapInArrow(_expected(tagger.models), schema).groupBy("lang", "slot").agg(*[F.sum(t).alias(t) for t in TAGS])
        totals = {lang: np.zeros((2 + len(TAGS) + len(m.classes), len(TAGS))) for lang, m in tagger.models.items()}
        for r in sums.toLocalIterator():
            totals[r.lang][r.slot] = [r[t] / UNIT for t in TAGS]
        tagger.history.append(sum(totals[lang][1, 0] + log_prior(m, smoothing) for lang, m in tagger.models.items()))
        tagger.models = {lang: _maximise(m, totals[lang], smoothing) for lang, m in tagger.models.items()}
    return tagger


def log_prior(hmm: Hmm, smoothing: float) -> float:
    if not smoothing:
        return 0.0
    return smoothing * float(np.log(hmm.start).sum() + np.log(hmm.trans).sum() + np.log(hmm.emit).sum())


def _maximise(hmm: Hmm, total: np.ndarray, smoothing: float) -> Hmm:
    def shares(x: np.ndarray, old: np.ndarray) -> np.ndarray:
        x = x + smoothing
        size = x.sum(-1, keepdims=True)
        return np.where(size > 0, x / np.where(size > 0, size, 1), old)
    tags = len(TAGS)
    return Hmm(hmm.classes, shares(total[0], hmm.start), shares(total[2:2 + tags], hmm.trans), shares(total[2 + tags:].T, hmm.emit))


def count_tags(pairs: DataFrame, tagger: Tagger, cols: tuple[str, ...] = ("fr", "en"), key: str = "pair_id") -> DataFrame:
    """``key`` and, for each text column (named by its language), its number of verbs, nouns and entities: what
    ``curate(counts=...)`` takes. Rows stay where they are."""
    ship_package(pairs.sparkSession)
    tokens = pairs.select(key, *[token_forms(F.col(c)).alias(c) for c in cols])
    counted = ("verb", "noun", "entity")
    names = [f"{t}s_{c}" if t != "entity" else f"entities_{c}" for c in cols for t in counted]
    schema = f"{key} {pairs.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names)
    models = {c: tagger.models.get(c) or start_model({}) for c in cols}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[str, int]] = {c: {} for c in cols}
        for batch in batches:
            out = []
            for i, c in enumerate(cols, 1):
                counts = np.zeros((batch.num_rows, len(TAGS)), np.int64)
                for low, high, classes, lengths in _blocks(batch.column(i), models[c], known[c]):
                    if len(classes):
                        np.add.at(counts, (low + np.repeat(np.arange(high - low), lengths), viterbi(models[c], classes, lengths)), 1)
                missing = np.asarray(batch.column(i).is_null())
                out += [pa.array(counts[:, TAGS.index(t)], mask=missing) for t in counted]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=[key, *names])

    return tokens.mapInArrow(run, schema)
