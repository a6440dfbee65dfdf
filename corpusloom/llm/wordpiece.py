"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes with two roots: one for tokens that begin a word, one for tokens that
continue it. Each node has a failure link and a count of popped tokens: where no edge matches the next
byte, that many tokens of the greedy longest match are complete, and matching goes on from the link's
node without reading a byte again. The work is linear in the text and no piece is ever built.

A word is a run of anything but ASCII white space, as bytes of its UTF-8. Greedy longest match takes the
longest vocabulary token at the word's begin, then the longest continuing token, and so on. With
``bare_marker`` a word that no beginning token fits begins with the word marker alone, one token, and goes on
with continuing ones; a word that still can't be covered counts as one unknown token. All words of a block run through the automaton together.

Edge cases: null, empty and white-space-only texts have no words and no tokens. Rows are passed through
one by one, repeated ones alike; an empty table gives no rows. A very long text is counted whole; the words of a block
advance together, so a single very long unbroken word takes a step a byte (about 80 microseconds).
"""

from __future__ import annotations

import json
from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField

from .arrow import append_columns, runs
from .bpe import byte_letters

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Automaton:
    """Edges (a hash table of (node, byte)), failure links and popped-token counts."""

    START, INSIDE = 0, 1

    def __init__(self, begins: set[bytes], continues: set[bytes], bare_marker: bool = False):
        children: list[dict[int, int]] = [{}, {}]
        token: set[int] = set()
        for root, tokens in ((self.START, begins), (self.INSIDE, continues)):
            for t in tokens:
                node = root
                for b in t:
                    if b not in children[node]:
                        children[node][b] = len(children)
                        children.append({})
                    node = children[node][b]
                if t:
                    token.add(node)
        fail, pops = [-1] * len(children), [0] * len(children)
        if bare_marker:
            fail[self.START], pops[self.START] = self.INSIDE, 1
        queue = deque((root, b, v) for root in (0, 1) for b, v in children[root].items())
        while queue:
            parent, b, v = queue.popleft()
            if v in token:
                fail[v], pops[v] = self.INSIDE, 1
            else:
                z, n = fail[parent], pops[parent]
                while z >= 0 and b not in children[z]:
                    n, z = n + pops[z], fail[z]
                if z >= 0:
                    fail[v], pops[v] = children[z][b], n
            queue.extend((v, c, w) for c, w in children[v].items())
        self.fail, self.pops = np.array(fail, np.int32), np.array(pops, np.int32)
        keys = np.array([u << 8 | b for u, edges in enumerate(children) for b in edges], np.int64)
        values = np.array([v for edges in children for v in edges.values()], np.int32)
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = np.zeros(len(slot), bool)
            put[first] = True
            put &= free
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            keys, values, slot = keys[~put], values[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def children(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node by each byte, or -1."""
        key = node.astype(np.int64) << 8 | byte
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.values[slot], -1)
        todo = np.flatnonzero((there != key) & (there >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[todo]]
            same = there == key[todo]
            out[todo[same]] = self.values[slot[todo[same]]]
            todo = todo[~same & (there >= 0)]
        return out

    def count(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each word ``data[begin:end]``; -1 for a word that can't be covered."""
        total, unknown = np.zeros(len(begins), np.int64), np.zeros(len(begins), bool)
        word, node, at = np.arange(len(begins)), np.zeros(len(begins), np.int32), begins.copy()
        while len(word):
            more = at < ends[word]
            child = np.full(len(word), -1, np.int32)
            child[more] = self.children(node[more], data[at[more]])
            back = child < 0
            total[word[back]] += self.pops[node[back]]
            node = np.where(back, self.fail[node], child)
            at += ~back
            unknown[word[node < 0]] = True
            go = (node >= 0) & ~((at >= ends[word]) & (node == self.INSIDE))
            word, node, at = word[go], node[go], at[go]
        return np.where(unknown, -1, total)


def automaton(path: str, marker: str = "Ġ", bare_marker: bool = False) -> Automaton:
    """From a byte-level BPE file of the tokenizers library: tokens with the word marker begin a word, the
    others continue one. With ``bare_marker`` the marker itself, if it is a token, begins the words that no other
    one fits. Special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte = {c: b for b, c in byte_letters().items()}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    tokens = [t for t in spec["model"]["vocab"] if t not in special]
    spell = lambda t: bytes(byte[c] for c in t)
    return Automaton({spell(t[len(marker):]) for t in tokens if t.startswith(marker) and t != marker},
                     {spell(t) for t in tokens if not t.startswith(marker)}, bare_marker and marker in tokens)


def count_tokens(df: DataFrame, machine: Automaton, text_col: str = "text") -> DataFrame:
    """``df`` with ``n_words``, ``n_tokens`` (unknown words count one) and ``n_unknown``. No shuffle; the broadcast
    automaton is bounded by the vocabulary."""
    shared = df.sparkSession.sparkContext.broadcast(machine)
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True

    def run(texts):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
        starts = 1 + np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])[:-1]])
        begins, ends = runs(~space[data])
        counts = shared.value.count(data, begins, ends)
        document, n = np.searchsorted(starts, begins, "right") - 1, len(texts)
        total = lambda x: np.bincount(document, x, n).astype(np.int64)
        return {"n_words": total(np.ones(len(begins))), "n_tokens": total(np.maximum(counts, 0) + (counts < 0)), "n_unknown": total(counts < 0)}

    return append_columns(df, text_col, [StructField(c, LongType()) for c in ("n_words", "n_tokens", "n_unknown")], run)
