"""Language identification by a linear-chain conditional random field over words.

A word is a run of letters, a chain the words of one line (a line of more than ``CHAIN`` words is
several chains). The score of a label for a word is the sum of learned weights of

* character n-grams (n = 2, 3, 4) of the lower-cased word,
* its affixes: the n-grams that touch the word's edge carry an edge mark, so prefixes and suffixes of
  one to three letters are features of their own,
* the word itself, if it is in the lexicon (words seen at least twice in training), else a weight
  for unknown words.

A learned matrix scores each transition between the labels of neighbouring words. Forward-backward
gives every word its marginal label probabilities, so a code-switched text gets word labels; a
document's language is the label with the largest mean marginal over its words.

Training maximises the regularised log-likelihood (Adam, gradients from forward-backward) on a
bounded sample of chains. A share of the training chains is spliced from two languages, so switches
have a learned cost rather than an infinite one.

Edge cases: a null text or one without letters is ``und`` with score 0; equal scores go to the smaller
label by code point; with no labelled row at all everything is ``und``. Repeated rows are scored alike. A very long
text is scored whole and alone in its block, with one number a character and label for each n-gram order. An empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField

from .arrow import LETTER, append_columns, bound_batches, character_kinds, code_points, hash_share, runs, span_hashes

ORDERS = (2, 3, 4)
BUCKETS = 1 << 16
CHAIN = 64
#: So many documents of a language are expected in the smallest sample; that none is chosen has a chance of e**-20.
LEAST_DOCS = 20
UND = "und"


@dataclass
class Model:
    labels: list[str]
    grams: np.ndarray        # (len(ORDERS) * BUCKETS, labels)
    lexicon: np.ndarray      # sorted word hashes
    words: np.ndarray        # (1 + len(lexicon), labels); row 0: unknown words
    moves: np.ndarray        # (labels, labels)


class Block:
    """Words, chains and feature indices of a block of texts."""

    def __init__(self, texts: list[str | None]):
        cps, begins = code_points([(t or "").lower() for t in texts])
        letter = character_kinds()[cps] == LETTER
        self.begins, self.ends = runs(letter)
        self.document = np.searchsorted(begins, self.begins, "right") - 1
        self.cps = np.where(letter, cps, 0).astype(np.uint64)
        line = np.searchsorted(np.flatnonzero(cps == 10), self.begins)
        n = len(self.begins)
        first = np.ones(n, bool)
        first[1:] = line[1:] != line[:-1]
        heads = np.flatnonzero(first)
        within = np.arange(n) - (heads[np.cumsum(first) - 1] if n else 0)
        starts = np.flatnonzero(within % CHAIN == 0)
        lengths = np.diff(np.append(starts, n))
        order = np.argsort(-lengths, kind="stable")
        self.starts, self.lengths = starts[order], lengths[order]

    def grams(self, n: int) -> np.ndarray:
        """The bucket of the n-gram that begins at each character (edge marks are 0)."""
        h = np.zeros(len(self.cps), np.uint64)
        for k in range(n):
            h *= np.uint64(0x100000001B3)
            h[: len(h) - k] += self.cps[k:] + np.uint64(1)
        h *= np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(48)).astype(np.int64)

    def spans(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last n-gram of each word, its two edge marks included."""
        first = self.begins - 1
        return first, np.maximum(self.ends + 2 - n, first)

    def word_rows(self, lexicon: np.ndarray) -> np.ndarray:
        hashes = span_hashes(self.cps, self.begins, self.ends)
        if not len(lexicon):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
        return np.where(lexicon[at] == hashes, at + 1, 0)

    def scores(self, m: Model) -> np.ndarray:
        out = m.words[self.word_rows(m.lexicon)].astype(np.float64)
        for i, n in enumerate(ORDERS):
            weights = m.grams[i * BUCKETS:(i + 1) * BUCKETS][self.grams(n)]
            sums = np.concatenate([np.zeros((1, weights.shape[1])), np.cumsum(weights, 0, np.float64)])
            first, last = self.spans(n)
            out += sums[last] - sums[first]
        return out

    def steps(self):
        """For each position in a chain, the words of the chains that reach it."""
        for t in range(int(self.lengths[0]) if len(self.lengths) else 0):
            yield self.starts[: np.searchsorted(-self.lengths, -t, "left")] + t

    def forward_backward(self, scores: np.ndarray, moves: np.ndarray):
        """Marginals of every word, summed marginals of neighbouring pairs, and the log-likelihood's normaliser."""
        top = scores.max(1, keepdims=True) if len(scores) else scores
        local, step = np.exp(scores - top), np.exp(moves)
        ahead, back, scale = np.empty_like(local), np.ones_like(local), np.ones(len(local))
        steps = list(self.steps())
        for t, rows in enumerate(steps):
            a = local[rows] if t == 0 else (ahead[rows - 1] @ step) * local[rows]
            scale[rows] = total = a.sum(1)
            ahead[rows] = a / total[:, None]
        pairs = np.zeros_like(step)
        for rows in steps[:0:-1]:
            b = local[rows] * back[rows] / scale[rows][:, None]
            pairs += (ahead[rows - 1].T @ b) * step
            back[rows - 1] = b @ step.T
        marginals = ahead * back
        return marginals, pairs, float(np.log(scale).sum() + (top.sum() if len(top) else 0))


def predict_words(model: Model, text: str) -> list[tuple[str, str, float]]:
    """(word, label, probability) for the words of one text; for a look at code-switched text."""
    if not model.labels:
        return []
    b = Block([text])
    p, _, _ = b.forward_backward(b.scores(model), model.moves)
    lowered = "\n" + text.lower()
    return [(lowered[s:e], model.labels[k], float(q)) for s, e, k, q in zip(b.begins, b.ends, p.argmax(1), p.max(1))]


def known_share(block: Block, model: Model, n_texts: int) -> np.ndarray:
    """For each text, the share of its words' 3-grams (edges included) that training saw, beyond the share that chance
    would give: 1 if all were seen, about 0 for a script or language that no label has. A bucket that training never
    met has no weight. With very many labels most buckets are met and the measure loses its force, not its scale."""
    i = ORDERS.index(3)
    met = (model.grams[i * BUCKETS:(i + 1) * BUCKETS] != 0).any(1)
    chance = met.mean()
    sums = np.concatenate([[0], np.cumsum(met[block.grams(3)])])
    first, last = block.spans(3)
    seen, grams = (np.bincount(block.document, x, n_texts) for x in (sums[last] - sums[first], last - first))
    share = seen / np.maximum(grams, 1)
    return np.clip((share - chance) / max(1e-9, 1 - chance), 0.0, 1.0) if chance < 1 else (grams > 0).astype(float)


def label_languages(df: DataFrame, model: Model, text_col: str = "text", evidence: bool = False) -> DataFrame:
    """With ``evidence`` there is also ``known``, the ``known_share`` of the text. ``df`` with ``lang_pred``, ``score`` (mean marginal of that label), ``n_words`` (runs of letters)
    and ``n_switches`` (neighbouring words of a chain with different labels). One row per input row,
    no shuffle; the model (fixed tables of 0.8 MB a label, and the lexicon of the bounded sample) is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType()),
              StructField("n_words", LongType()), StructField("n_switches", LongType())]
    fields += [StructField("known", DoubleType())] * evidence

    def label(texts):
        m, n = shared.value, len(texts)
        b = Block(texts)
        words = np.bincount(b.document, minlength=n)
        if not m.labels:
            return {"lang_pred": [UND] * n, "score": np.zeros(n), "n_words": words, "n_switches": np.zeros(n, np.int64), "known": np.zeros(n)}
        p, _, _ = b.forward_backward(b.scores(m), m.moves)
        share = np.stack([np.bincount(b.document, p[:, k], n) for k in range(len(m.labels))], 1)
        share = share / np.maximum(words, 1)[:, None]
        best = np.round(share, 12).argmax(1)
        tags, inner = p.argmax(1), np.ones(len(p), bool)
        inner[b.starts] = False
        at = np.flatnonzero(inner)
        switches = np.bincount(b.document[at], tags[at] != tags[at - 1], n).astype(np.int64)
        return {"lang_pred": [m.labels[k] if w else UND for k, w in zip(best, words)],
                "score": np.clip(np.where(words > 0, share[np.arange(n), best], 0.0), 0.0, 1.0),
                "n_words": words, "n_switches": switches, "known": known_share(b, m, n) if evidence else None}

    return append_columns(df, text_col, fields, label)


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          docs_per_language: int = 150, chains_per_doc: int = 4, full_languages: int = 20,
          rounds: int = 40) -> Model:
    """Fits the model on a bounded sample of labelled rows: about ``docs_per_language`` documents of every
    language, chosen by a hash of their id, and ``chains_per_doc`` chains of at most ``CHAIN`` words spread over
    each of them (about 40,000 words a language). All labels are learned. The driver's dense arrays have a row a
    word and a column a language, so beyond ``full_languages`` languages the sample of each shrinks with the square
    of their number: fewer chains of a document first, then fewer documents, but at least about ``LEAST_DOCS``. The
    number of labelled documents of each language is counted over all rows; prediction covers all texts."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")) \
             .where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return Model([], np.zeros((len(ORDERS) * BUCKETS, 0), np.float32), np.zeros(0, np.uint64), np.zeros((1, 0)), np.zeros((0, 0)))
    docs_per_language, chains_per_doc = _sample_size(len(counts), docs_per_language, chains_per_doc, full_languages)
    shares = df.sparkSession.createDataFrame([(r["lang"], docs_per_language / r["count"]) for r in counts], "lang string, share double")

    def chains(batches):
        for batch in batches:
            ids, langs, out = batch.column(0).to_pylist(), batch.column(2).to_pylist(), ([], [], [])
            for i, text in enumerate(batch.column(1)):
                for k, piece in enumerate(_pieces(text.as_py(), chains_per_doc)):
                    out[0].append(langs[i])
                    out[1].append(f"{ids[i]}/{k:04d}")
                    out[2].append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], names=["lang", "key", "chain"])

    bound_batches(df.sparkSession)
    sample = rows.join(F.broadcast(shares), "lang").where(hash_share("id", F.col("share"))) \
                 .select("id", "text", "lang").mapInArrow(chains, "lang string, key string, chain string").collect()
    sample = sorted((r["lang"], r["key"], r["chain"]) for r in sample)
    return _fit([x[2] for x in sample], [x[0] for x in sample], sorted({x[0] for x in sample}), rounds)


def _sample_size(languages: int, docs: int, chains: int, full: int) -> tuple[float, int]:
    """Documents of a language and chains of a document, for so many languages."""
    share = min(1.0, (full / languages) ** 2)
    fewer = max(1, min(chains, int(chains * share)))
    return (docs if share == 1.0 else min(docs, max(LEAST_DOCS, docs * share * chains / fewer))), fewer


def _pieces(text: str, most: int) -> list[str]:
    """At most ``most`` chains, evenly spread over all chains of the text."""
    chains = [" ".join(w[i:i + CHAIN]) for line in text.split("\n") if (w := line.split()) for i in range(0, len(w), CHAIN)]
    return chains if len(chains) <= most else [chains[i * len(chains) // most] for i in range(most)]


def _fit(chains: list[str], langs: list[str], labels: list[str], rounds: int) -> Model:
    if not labels:
        return Model([], np.zeros((len(ORDERS) * BUCKETS, 0), np.float32), np.zeros(0, np.uint64), np.zeros((1, 0)), np.zeros((0, 0)))
    draw = np.random.default_rng(7)
    number = {x: i for i, x in enumerate(labels)}
    texts, owners = [], []
    for i, (chain, lang) in enumerate(zip(chains, langs)):
        parts, own = [chain], [number[lang]]
        if i % 4 == 0:  # spliced with a chain of any language
            j = int(draw.integers(len(chains)))
            parts, own = [*parts, chains[j]], [*own, number[langs[j]]]
        texts.append(" ".join(parts))
        owners.append(np.repeat(own, [len(runs(np.pad(character_kinds()[np.frombuffer(p.lower().encode("utf-32-le"), np.uint32)] == LETTER, 1))[0]) for p in parts]))
    block, gold = Block(texts), np.concatenate(owners) if owners else np.zeros(0, np.int64)
    n, k = len(block.begins), len(labels)
    hashes, seen = np.unique(span_hashes(block.cps, block.begins, block.ends), return_counts=True)
    m = Model(labels, np.zeros((len(ORDERS) * BUCKETS, k), np.float32), hashes[seen >= 2], None, np.zeros((k, k)))
    m.words = np.zeros((1 + len(m.lexicon), k))
    word_rows = block.word_rows(m.lexicon)
    buckets, owner = [], []
    for i, order in enumerate(ORDERS):
        first, last = block.spans(order)
        count = last - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        buckets.append(block.grams(order)[at] + i * BUCKETS)
        owner.append(np.repeat(np.arange(n), count))
    buckets, owner = np.concatenate(buckets), np.concatenate(owner)
    truth = np.zeros((n, k))
    truth[np.arange(n), gold] = 1
    inner = np.ones(n, bool)
    inner[block.starts] = False
    at = np.flatnonzero(inner)
    moved = np.zeros((k, k))
    np.add.at(moved, (gold[at - 1], gold[at]), 1)
    params = [m.grams.astype(np.float64), m.words, m.moves]
    decay = [0.02, 0.02, 0.5]
    first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    per_label = lambda rows, values, size, of=slice(None): np.stack([np.bincount(rows, values[:, j][of], size) for j in range(k)], 1)
    for r in range(1, rounds + 1):
        scores = params[1][word_rows] + np.stack([np.bincount(owner, params[0][buckets, j], n) for j in range(k)], 1)
        p, pairs, _ = block.forward_backward(scores, params[2])
        wrong = p - truth
        gradients = [per_label(buckets, wrong, len(params[0]), owner), per_label(word_rows, wrong, len(params[1])), pairs - moved]
        for i, g in enumerate(gradients):
            g += decay[i] * params[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] -= 0.1 * (first[i] / (1 - 0.9 ** r)) / (np.sqrt(second[i] / (1 - 0.99 ** r)) + 1e-3)
    m.grams, m.words, m.moves = params[0].astype(np.float32), params[1], params[2]
    return m
