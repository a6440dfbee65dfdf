"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A text is cut at special tokens and then into pieces by the byte-level pattern. For each piece the
leaves of a segment tree hold the rank of every adjacent pair of tokens (or "no merge"), packed with its
position, and every inner node the minimum of its children, so the root is the leftmost pair of lowest
rank. A merge joins the pair, removes the right token from a linked list and updates the two or three
leaves that change, each in logarithmic time, until the root says that no pair can be merged.

Short pieces are merged many at a time: their trees are rows of one array, and each round reads all
roots and updates all paths at once. Longer pieces have a tree of their own. Tokens of pieces already
seen are kept in a table of bounded size (dropped when full and at a task's end), so memory doesn't follow
the corpus.

Decoding maps ids back to bytes, joins them, and reads UTF-8 with replacement characters for broken
sequences; special tokens are kept as their text.

Edge cases: a null text is empty and has no tokens. An unknown id decodes to nothing. Repeated rows and
other columns are passed through.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField

from .arrow import append_columns

#: Fixed value: the byte-level pattern that cuts a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = 64
#: Merging many new pieces at once is cheaper, so blocks are larger than the other operators'.
BLOCK_CHARS = 1_500_000
KNOWN_PIECES = 200_000
#: Trees that are merged together in one array.
TOGETHER = 1 << 13
NONE = np.int64(1 << 62)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the
    others numbered from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file (JSON text of the tokenizers library)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        byte = {c: b for b, c in byte_letters().items()}
        self.bytes_of = {i: bytes(byte[c] for c in t) for t, i in vocab.items() if all(c in byte for c in t)}
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in byte.items():
            self.byte_ids[b] = vocab[c]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))
        self._piece = regex.compile(PATTERN)
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._known: dict[str, list[int]] = {}
        self._special_tokens = {t: [i] for t, i in self.special.items()}
        top = max(vocab.values(), default=0) + len(self.special) + 1
        self.size = top
        self._byte_table = [self.bytes_of.get(i, b"") for i in range(top)]
        self._decimal = [str(i) for i in range(top)]

    # -- encoding

    def ranks_for(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of each text."""
        cut = [self._pieces(t) for t in texts]
        if len(self._known) > KNOWN_PIECES:
            self._known = {}
        fresh = sorted(set().union(*cut).difference(self._known))
        self._known.update(zip(fresh, self._merge([p.encode("utf-8", "surrogatepass") for p in fresh])))
        self._known.update(self._special_tokens)
        tokens = self._known.__getitem__
        return [list(chain.from_iterable(map(tokens, pieces))) for pieces in cut]

    def forget(self) -> None:
        """Lets go of the known pieces."""
        self._known = {}

    def _pieces(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self._cut is None or not self._cut.search(text):
            return self._piece.findall(text)
        parts = self._cut.split(text)
        return [p for part in parts for p in ([part] if part in self.special else self._piece.findall(part))]

    def _merge(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = 1
        while width < SHORT:
            low, width = width, width * 2
            rows = np.flatnonzero((lengths <= width) & (lengths > (low if low > 1 else 0)))
            for i in range(0, len(rows), TOGETHER):
                group = rows[i:i + TOGETHER]
                for r, ids in zip(group.tolist(), self._merge_together([pieces[r] for r in group], lengths[group], width)):
                    out[r] = ids
        for r in np.flatnonzero(lengths > SHORT).tolist():
            out[r] = self._merge_alone(pieces[r])
        return out

    def _merge_together(self, pieces: list[bytes], lengths: np.ndarray, width: int) -> list[list[int]]:
        """Segment trees of many pieces of at most ``width`` bytes (a power of two), a row each."""
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = self.byte_ids[raw]
        place = np.arange(width)
        alive = place < lengths[:, None]
        after = np.where(place + 1 < lengths[:, None], place + 1, width)  # next token's place; width: none
        after = np.concatenate([after, np.full((n, 1), width)], 1)
        prior = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE, np.int64)
        rank = self.ranks_for(ids[:, :-1], ids[:, 1:])
        ok = (rank >= 0) & alive[:, 1:]
        tree[:, width:2 * width - 1] = np.where(ok, rank << 8 | place[:-1], NONE)
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            at, rank = root & 255, root >> 8
            gone = after[rows, at]
            then = after[rows, gone]
            ids[rows, at] = self.merged[rank]
            alive[rows, gone] = False
            after[rows, at] = then
            has = then < width
            prior[rows[has], then[has]] = at[has]
            self._update(tree, width, rows, gone, np.full(len(rows), NONE))
            self._update(tree, width, rows[has], at[has], self._leaf(ids, rows[has], at[has], then[has]))
            self._update(tree, width, rows[~has], at[~has], np.full((~has).sum(), NONE))
            before = prior[rows, at]
            has = before >= 0
            self._update(tree, width, rows[has], before[has], self._leaf(ids, rows[has], before[has], at[has]))
            rows = rows[tree[rows, 1] < NONE]
        flat, ends = ids[alive].tolist(), np.cumsum(alive.sum(1)).tolist()
        return [flat[i:j] for i, j in zip([0, *ends], ends)]

    def _leaf(self, ids: np.ndarray, rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        rank = self.ranks_for(ids[rows, left], ids[rows, right])
        return np.where(rank >= 0, rank << 8 | left, NONE)

    @staticmethod
    def _update(tree: np.ndarray, width: int, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + width
        tree[rows, node] = value
        while width > 1:
            node, width = node >> 1, width >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def _merge_alone(self, piece: bytes) -> list[int]:
        """The segment tree of one long piece."""
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        none, merged, rank_of = int(NONE), self.merged, self.rank_of
        leaves = np.full(width, NONE)
        rank = self.ranks_for(ids[:-1], ids[1:])
        leaves[: n - 1] = np.where(rank >= 0, rank << 32 | np.arange(n - 1), NONE)
        levels = [leaves]
        while len(levels[0]) > 1:
            levels.insert(0, np.minimum(levels[0][0::2], levels[0][1::2]))
        tree = [none] + [int(x) for level in levels for x in level]
        ids, after, prior = ids.tolist(), [*range(1, n), -1], [*range(-1, n - 1)]

        def update(leaf: int, value: int) -> None:
            node = leaf + width
            tree[node] = value
            while node > 1:
                a, b, node = tree[node], tree[node ^ 1], node >> 1
                least = a if a < b else b
                if tree[node] == least:
                    return
                tree[node] = least

        def pair(left: int, right: int) -> int:
            r = rank_of.get(ids[left] << 32 | ids[right])
            return none if r is None else r << 32 | left

        while tree[1] < none:
            at, rank = tree[1] & 0xFFFFFFFF, tree[1] >> 32
            gone = after[at]
            then, before = after[gone], prior[at]
            ids[at], ids[gone], after[at] = int(merged[rank]), -1, then
            update(gone, none)
            if then >= 0:
                prior[then] = at
            update(at, pair(at, then) if then >= 0 else none)
            if before >= 0:
                update(before, pair(before, at))
        return [i for i in ids if i >= 0]

    # -- decoding

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self._byte_table.__getitem__, ids)).decode("utf-8", "replace")

    def decimal(self, ids: list[int]) -> str:
        """The ids in decimal, joined by commas."""
        return ",".join(map(self._decimal.__getitem__, ids))


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(source: str) -> Vocabulary:
    """The vocabulary of a file's text; parsed once per Python process."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[key] = Vocabulary(source)
    return _VOCABULARIES[key]


def _shared(df: DataFrame, path: str):
    """The vocabulary file's text, read on the driver and broadcast (a few MB, independent of the corpus)."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``ids`` (array of int). No shuffle."""
    source = _shared(df, path)
    return append_columns(df, text_col, [StructField("ids", ArrayType(IntegerType()))],
                          lambda texts: {"ids": vocabulary(source.value).encode_all(texts)}, BLOCK_CHARS,
                          close=lambda: vocabulary(source.value).forget())


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` (string), the text of the token ids. No shuffle."""
    source = _shared(df, path)

    def run(rows):
        v = vocabulary(source.value)
        return {"decoded": [v.decode([i for i in ids or [] if i is not None and 0 <= i < v.size]) for ids in rows]}

    return append_columns(df, ids_col, [StructField("decoded", StringType())], run)


def round_trip(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas) and ``decoded_sha256`` (of the
    decoded text): ``encode`` and ``decode`` in one pass, without writing ids or texts out."""
    source = _shared(df, path)
    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]

    def run(texts):
        v = vocabulary(source.value)
        ids = v.encode_all(texts)
        return {"n_tokens": [len(x) for x in ids],
                "ids_sha256": [hashlib.sha256(v.decimal(x).encode()).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(v.decode(x).encode()).hexdigest() for x in ids]}

    return append_columns(df, text_col, fields, run, BLOCK_CHARS, close=lambda: vocabulary(source.value).forget())
