"""Cutting texts into pre-tokens with numpy, and giving each distinct pre-token its ids once.

A text is a vector of code points. Class changes (letter, number, space, other) mark where pre-tokens start; the
rules about single spaces, digits and contractions move some of these marks. Pre-tokens are grouped by 64-bit hashes and
compared character by character, so a task encodes every distinct one once and lays the ids out by repetition.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from examloom.llm.text_arrays import flat, groups, mixed, span_hashes

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Code points with the White_Space property.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings that are pre-tokens of their own behind an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Code points are handled in runs of about this many; a longer text comes alone.
BLOCK = 1 << 18
#: A task forgets its pre-tokens when it knows so many.
MOST_KNOWN = 1 << 18
#: Bytes of text that become Python strings at once.
STRING_BYTES = 1 << 20


def strings(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column (null: empty) in runs of about STRING_BYTES: a whole batch as Python strings would take several times its size."""
    _, offsets = flat(column)
    for lo, hi in groups(offsets, STRING_BYTES):
        yield [t or "" for t in column.slice(lo, hi - lo).to_pylist()]


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    # Two letters each, of which the first counts.
    names = np.frombuffer("".join(map(unicodedata.category, map(chr, range(0x110000)))).encode(), np.uint8)[::2]
    first = np.full(len(names), OTHER, np.uint8)
    first[names == ord("L")] = LETTER
    first[names == ord("N")] = NUMBER
    first[WHITE] = SPACE
    return first


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of the texts, one after the other."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def _contractions(x: np.ndarray, start: np.ndarray, edge: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(positions of apostrophes that start a pre-token with an ending behind them, length of the ending)."""
    at = np.flatnonzero((x == 39) & start)
    out = []
    for e in ENDINGS:
        hit = at[at + len(e) < len(x)]
        for j, c in enumerate(e):
            hit = hit[(x[hit + 1 + j] == ord(c)) & ~edge[hit + 1 + j]]
        out.append((hit, len(e)))
        at = np.setdiff1d(at, hit, assume_unique=True)
    return out


def _marks(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, starts of runs of a class within a text, starts of texts)."""
    kind = classes()[x]
    edge = np.zeros(len(x) + 1, bool)
    edge[offsets] = True
    start = edge[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    return kind, start, edge[:-1]


def dropping_spaces(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends): letters, single digits, contractions and runs of anything else; white space falls out."""
    kind, start, edge = _marks(x, offsets)
    for hit, n in _contractions(x, start, edge):
        start[hit + 1] = False
        behind = hit + 1 + n
        start[behind[behind < len(x)]] = True
    start |= kind == NUMBER
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(x))
    # An apostrophe's run goes on behind it where no ending follows; where one does, it is cut off before.
    keep = kind[starts] != SPACE
    return starts[keep], ends[keep]


def keeping_spaces(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) with nothing lost: a single space joins what follows, longer white space leaves its last character to do so."""
    kind, start, edge = _marks(x, offsets)
    n = len(x)
    first = np.flatnonzero(start)
    stop = np.append(first[1:], n)
    blank = kind[first] == SPACE
    last = stop[blank] - 1
    follows = (stop[blank] < n) & ~np.append(edge, True)[np.minimum(stop[blank], n)]
    # The last white-space character stands apart where text follows, and joins it if it is a space.
    start[last[follows]] = True
    joined = last[follows & (x[np.minimum(last, n - 1)] == 32)]
    start[joined + 1] = False
    for hit, k in _contractions(x, start, edge):
        start[hit + 1] = False
        behind = hit + 1 + k
        start[behind[behind < n]] = True
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n)


def rows_of(store: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of store[start : start + size] for all rows, one after the other."""
    at = np.append(0, np.cumsum(sizes))
    return store[np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])], at


class Encoder:
    """Ids of texts. ``encode_words`` gets distinct pre-tokens and returns their ids in a row, and the number of each one's; it is called for unknown ones only.

    Known pre-tokens lie in flat arrays in order of their hashes, with their characters: a hash only says where to look, and
    characters are compared, so two pre-tokens of one hash never get each other's ids.
    """

    def __init__(self, cut: Callable, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.cut, self.encode_words = cut, encode_words
        self.forget()

    def forget(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.ids_at = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64)
        self.points, self.points_at = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64)

    @staticmethod
    def _append(store: np.ndarray, at: np.ndarray, k: int, values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adds rows k, k + 1 ... to rows of ``store`` that start at ``at``."""
        n, used = len(counts), int(at[k])
        if k + n >= len(at):
            at = np.resize(at, max(2 * len(at), k + n + 1))
        if used + len(values) > len(store):
            store = np.resize(store, max(2 * len(store), used + len(values)))
        np.cumsum(counts, out=at[k + 1 : k + n + 1])
        at[k + 1 : k + n + 1] += used
        store[used : used + len(values)] = values
        return store, at

    def _learn(self, hashes: np.ndarray, x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        points, _ = rows_of(x, starts, ends - starts)
        text = points.tobytes().decode("utf-32-le", "surrogatepass")
        at = np.append(0, np.cumsum(ends - starts)).tolist()
        ids, counts = self.encode_words([text[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
        k = len(self.hashes)
        self.ids, self.ids_at = self._append(self.ids, self.ids_at, k, ids, counts)
        self.points, self.points_at = self._append(self.points, self.points_at, k, points, ends - starts)
        where = np.searchsorted(self.hashes, hashes)
        self.slots = np.insert(self.slots, where, np.arange(k, k + len(hashes), dtype=np.int32))
        self.hashes = np.insert(self.hashes, where, hashes)

    def _plainly(self, texts: list[str], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens, number of each one's) without hashes."""
        whole = "".join(texts)
        ids, counts = self.encode_words([whole[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        return ids.astype(np.int32), counts

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a few texts."""
        x, offsets = code_points(texts)
        starts, ends = self.cut(x, offsets) if len(x) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        hashes = span_hashes(mixed(x.astype(np.uint64)), starts, ends)
        # Any example will do, so the sort need not be stable, which np.unique would make it.
        order = np.argsort(hashes)
        ranked = hashes[order]
        fresh = np.append(True, ranked[1:] != ranked[:-1])
        distinct, example = ranked[fresh], order[fresh]
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(fresh) - 1
        sizes = ends - starts
        if len(self.hashes) + len(distinct) > MOST_KNOWN:
            self.forget()
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(0, len(self.hashes) - 1))
        new = self.hashes[at] != distinct if len(self.hashes) else np.ones(len(distinct), bool)
        if new.any():
            self._learn(distinct[new], x, starts[example[new]], ends[example[new]])
            at = np.searchsorted(self.hashes, distinct)
        slot = self.slots[at]
        own, _ = rows_of(x, starts, sizes)
        known_sizes = self.points_at[slot + 1] - self.points_at[slot]
        same = np.array_equal(known_sizes[inverse], sizes) and np.array_equal(rows_of(self.points, self.points_at[slot][inverse], sizes)[0], own)
        if same:
            slot = slot[inverse]
            count = self.ids_at[slot + 1] - self.ids_at[slot]
            ids, _ = rows_of(self.ids, self.ids_at[slot], count)
        else:
            ids, count = self._plainly(texts, starts, ends)
        total = np.append(0, np.cumsum(count))
        return ids, total[np.searchsorted(starts, offsets)]

    def all(self, texts: list[str]):
        """Ids of each text in turn."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= BLOCK):
                size += len(texts[hi])
                hi += 1
            ids, cuts = self.block(texts[lo:hi])
            for i in range(hi - lo):
                yield ids[cuts[i] : cuts[i + 1]]
            lo = hi
