"""Operator 6, byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token's symbols are the leaves of a segment tree; a leaf holds the merge rank of its symbol and the next. The
root yields the lowest rank, and among equals the leftmost pair. A merge changes three leaves, each in a
logarithmic number of steps, until the root holds no rank.

``SegmentTree`` does this for one pre-token. ``merge_batch`` does it for many short ones at once: the trees of all
are rows of one array, and each step merges one pair in every row that still has one.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from examloom.llm.batches import in_small_batches
from examloom.llm.pretokens import Encoder, keeping_spaces, strings

#: Rank of a pair that never merges.
NONE = (1 << 62) - 1
#: Pre-tokens of more bytes than this get a tree of their own.
SHORT = 64


@cache
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = (chr(256 + i) for i in range(256))
    return [chr(b) if b in own else next(rest) for b in range(256)]


class Vocabulary:
    """Byte ids, merge ranks and bytes of ids, from a byte-level BPE file in the JSON form of public tokenizers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.byte_ids = np.array([vocab[s] for s in symbols], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order, merged[order]
        self.pairs = {int(k): (r, int(m)) for r, (k, m) in enumerate(zip(keys, merged, strict=True))}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items() if s not in self.special}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or NONE, merged id) of each pair; a negative symbol has no pair."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NONE), self.merged[at]


class SegmentTree:
    """Minimum over leaves; ``root`` is (lowest value, its leftmost place)."""

    def __init__(self, values: list[int]):
        self.size = 1 << max(1, (len(values) - 1).bit_length())
        self.tree = [NONE] * self.size + values + [NONE] * (self.size - len(values))
        for i in range(self.size - 1, 0, -1):
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def set(self, i: int, value: int) -> None:
        i += self.size
        tree = self.tree
        tree[i] = value
        while i > 1:
            i >>= 1
            low = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == low:
                return
            tree[i] = low

    def root(self) -> tuple[int, int]:
        low, i = self.tree[1], 1
        if low == NONE:
            return NONE, -1
        while i < self.size:
            i *= 2
            i += self.tree[i] != low
        return low, i - self.size


def merge_one(symbols: list[int], vocab: Vocabulary) -> list[int]:
    """Ids of one pre-token from its byte ids."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pairs = vocab.pairs
    rank = lambda i: pairs.get(symbols[i] << 32 | symbols[after[i]], (NONE, 0))[0] if after[i] < n else NONE
    tree = SegmentTree([rank(i) for i in range(n)])
    while (i := tree.root()[1]) >= 0:
        j = after[i]
        symbols[i] = pairs[symbols[i] << 32 | symbols[j]][1]
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        symbols[j] = -1
        tree.set(j, NONE)
        tree.set(i, rank(i))
        if before[i] >= 0:
            tree.set(before[i], rank(before[i]))
    return [s for s in symbols if s >= 0]


def _raise_up(tree: np.ndarray, size: int, row: np.ndarray, leaf: np.ndarray) -> None:
    node = leaf + size
    while size > 1:
        node >>= 1
        tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
        size >>= 1


def merge_batch(symbols: np.ndarray, lengths: np.ndarray, vocab: Vocabulary) -> list[np.ndarray]:
    """Ids of many pre-tokens. ``symbols``: a row each, filled up with -1 to a power of two."""
    n, size = symbols.shape
    symbols = symbols.copy()
    column = np.arange(size)
    after = np.broadcast_to(column + 1, (n, size)).copy()
    before = np.broadcast_to(column - 1, (n, size)).copy()
    # A leaf's value holds the rank above its place, so that equal ranks are told apart by place, the leftmost first.
    leaf = np.full((n, size), NONE, np.int64)
    low, _ = vocab.rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel())
    low = low.reshape(n, size - 1)
    leaf[:, :-1] = np.where(low < NONE, low * size + column[:-1], NONE)
    tree = np.full((n, 2 * size), NONE, np.int64)
    tree[:, size:] = leaf
    k = size
    while k > 1:
        tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
        k //= 2
    row = np.flatnonzero(tree[:, 1] < NONE)
    while len(row):
        i = tree[row, 1] & (size - 1)
        j = after[row, i]
        symbols[row, i] = vocab.rank(symbols[row, i], symbols[row, j])[1]
        symbols[row, j] = -1
        k = after[row, j]
        after[row, i] = k
        inner = k < size
        before[row[inner], k[inner]] = i[inner]
        tree[row, size + j] = NONE
        right = np.where(inner, symbols[row, np.minimum(k, size - 1)], -1)
        low, _ = vocab.rank(symbols[row, i], right)
        tree[row, size + i] = np.where(low < NONE, low * size + i, NONE)
        _raise_up(tree, size, row, j)
        _raise_up(tree, size, row, i)
        h = before[row, i]
        some = h >= 0
        r, h = row[some], h[some]
        low, _ = vocab.rank(symbols[r, h], symbols[r, i[some]])
        tree[r, size + h] = np.where(low < NONE, low * size + h, NONE)
        _raise_up(tree, size, r, h)
        row = row[tree[row, 1] < NONE]
    return [s[s >= 0] for s in symbols]


def encode_words(words: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct pre-tokens in a row, and the number of each one's: short ones in batches of equal tree size, long ones alone."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    lengths = np.array([len(b) for b in raw], np.int64)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(raw)
    size = 2
    while size <= SHORT:
        pick = np.flatnonzero((lengths <= size) & (lengths > (size // 2 if size > 2 else 0)))
        for lo in range(0, len(pick), 4096):
            some = pick[lo : lo + 4096]
            codes = np.frombuffer(b"".join(raw[i].ljust(size, b"\0") for i in some.tolist()), np.uint8).reshape(len(some), size)
            symbols = np.where(np.arange(size) < lengths[some][:, None], vocab.byte_ids[codes], -1)
            for i, ids in zip(some.tolist(), merge_batch(symbols, lengths[some], vocab), strict=True):
                out[i] = ids
        size *= 2
    for i in np.flatnonzero(lengths > SHORT).tolist():
        out[i] = np.array(merge_one(vocab.byte_ids[np.frombuffer(raw[i], np.uint8)].tolist(), vocab), np.int64)
    return np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out))


class Codec:
    """Encodes and decodes texts as a byte-level vocabulary file says, special tokens in a text included."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.encoder = Encoder(keeping_spaces, lambda words: encode_words(words, self.vocab))
        names = sorted(self.vocab.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.names = tuple(names)
        self.pieces = np.array([self.vocab.bytes_of.get(i, b"") for i in range(max(self.vocab.bytes_of) + 1)], object)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts, owner = [], []
        for i, t in enumerate(texts):
            # A special token is its own id; what stands around it is cut on its own.
            for p in self.special.split(t) if self.special and any(s in t for s in self.names) else (t,):
                parts.append(p)
                owner.append(i)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        plain = [p if p not in self.vocab.special else "" for p in parts]
        for i, p, ids in zip(owner, parts, self.encoder.all(plain), strict=True):
            out[i].append(np.array([self.vocab.special[p]], np.int32) if p in self.vocab.special else ids)
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.pieces[ids].tolist()).decode("utf-8", "replace")


@cache
def codec(path: str) -> Codec:
    """One per Python worker and file."""
    return Codec(path)


def encode(text: Column, path: str) -> Column:
    """Ids of each text (null: empty), as little-endian unsigned 32-bit integers in a binary value."""

    @F.arrow_udf(T.BinaryType())
    def encoded(column: pa.Array) -> pa.Array:
        return pa.array([x.astype("<u4").tobytes() for texts in strings(column) for x in codec(path).encode(texts)], pa.binary())

    return encoded(text)


def decode(ids: Column, path: str) -> Column:
    """The text of each value that ``encode`` gave; special tokens stay."""

    @F.arrow_udf(T.StringType())
    def decoded(column: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([c.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in column], pa.string())

    return decoded(ids)


def round_trip(text: Column, path: str) -> Column:
    """struct<ids, decoded>: ``encode`` and ``decode`` in one function, so that a text is encoded once and by one worker."""
    kind = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    @F.arrow_udf(kind)
    def both(column: pa.Array) -> pa.Array:
        c, ids, decoded = codec(path), [], []
        for texts in strings(column):
            for x in c.encode(texts):
                ids.append(x.astype("<u4").tobytes())
                decoded.append(c.decode(np.frombuffer(ids[-1], "<u4")))
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=["ids", "decoded"])

    return both(text)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded text of every document.

    Null and empty texts have no ids. Repeated rows give repeated rows, an empty table an empty one; other columns aren't read.
    """
    return in_small_batches(docs).select("doc_id", round_trip(F.col("text"), path).alias("r")).select("doc_id", "r.ids", "r.decoded")
