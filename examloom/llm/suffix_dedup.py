"""Operator 1, suffix-array dedup: removes every byte of a 100-byte string that also starts earlier in the corpus.

1. *Anchors.* Of the 32-byte substrings in a 100-byte window, the one with the least hash is its anchor, so equal windows have
   equal anchors at equal places. Anchors are counted over the corpus; a window whose anchor occurs once has no equal.
2. *Shards.* What is left of some documents makes a shard. Its suffix array is refined by doubling (Larsson-Sadakane) to
   100 bytes, and common prefixes of neighbours (Kasai) show equal windows; all but the earliest are removed.
3. *Merging.* The earliest windows of each shard meet those of other shards under their anchor. There, their suffixes are sorted
   by their bytes, each window finds its like by binary search, and all but the earliest of equal ones are removed. Windows of
   hot anchors, which occur often, meet under 128 bits of hashes of their own bytes instead, so a frequent line between different
   texts is spread like any other text.
4. The removed windows of a document are joined with its text.

Texts cross the network once: both joins read the same exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from examloom.llm.batches import in_small_batches
from examloom.llm.text_arrays import MIX_A, MIX_B, MIX_C, byte_values, flat, groups, mixed

LENGTH, GRAM = 100, 32
#: Places of a window where its anchor may start.
PLACES = LENGTH - GRAM + 1
#: Bits of a place in a block; hashes keep the rest.
PLACE_BITS = 24
TEXT_BYTES = 1 << 19
#: Bytes whose suffixes are sorted at once.
SHARD_BYTES = 1 << 20
#: Windows that are merged at once, where their anchors allow; each takes its LENGTH bytes some three times.
MERGED = 1 << 18
#: Windows of anchors that occur more often are dealt out by their own hash.
HOT = 500
#: Rows of anchors that a task holds to find those that are hot already there, and the salts that spread those.
HELD, SALTS = 1 << 19, 4096
NO_DATA = np.zeros(0, np.int64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * MIX_A
    x += b * MIX_B
    x ^= x >> np.uint64(29)
    x *= MIX_C
    return x


def gram_hashes(data: np.ndarray, most: int, scramble: Callable = lambda x: x) -> dict[int, np.ndarray]:
    """Hashes of the substrings of 1, 2, 4 ... ``most`` bytes at every place."""
    out = {1: scramble(byte_values(data))}
    n = 1
    while n < most:
        h = out[n]
        out[2 * n] = _mix(h[:-n], h[n:]) if len(h) > n else h[:0]
        n *= 2
    return out


def window_hashes(data: np.ndarray, scramble: Callable = lambda x: x) -> np.ndarray:
    """Hashes of the LENGTH bytes at every place; with another ``scramble`` of the bytes' values, other hashes."""
    h = gram_hashes(data, 64, scramble)[64]
    rest = LENGTH - 64
    return _mix(h[:-rest], h[rest:]) if len(h) > rest else h[:0]


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, hash) of the runs of windows with one anchor; windows lie within a row of the block."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return NO_DATA, NO_DATA, np.zeros(0, np.uint64)
    h = gram_hashes(data, GRAM)[GRAM]
    low = (h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= PLACES:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (PLACES - width)], low[PLACES - width :])[:n]
    place = (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    ok = np.zeros(n + 1, bool)
    ends = np.maximum(offsets[1:] - LENGTH + 1, offsets[:-1])
    delta = np.zeros(len(data) + 1, np.int32)
    np.add.at(delta, offsets[:-1], 1)
    np.add.at(delta, ends, -1)
    ok[:n] = np.cumsum(delta)[:n] > 0
    start = ok[:n].copy()
    start[1:] &= (place[1:] != place[:-1]) | ~ok[: n - 1]
    first = np.flatnonzero(start)
    stop = ok[:n] & ~np.append(ok[1:n] & (place[1:] == place[:-1]), False)
    return first, np.flatnonzero(stop) + 1 - first, h[place[first]]


def blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, place in the first row, bytes, offsets): rows in blocks, and long rows in blocks that overlap by a window less one."""
    most = 1 << PLACE_BITS
    for lo, hi in groups(offsets, TEXT_BYTES):
        base, end = int(offsets[lo]), int(offsets[hi])
        if hi - lo > 1 or end - base <= most:
            yield lo, hi, 0, data[base:end], offsets[lo : hi + 1] - base
            continue
        for at in range(base, max(base + 1, end - LENGTH + 1), most - LENGTH + 1):
            part = data[at : min(end, at + most)]
            yield lo, hi, at - base, part, np.array([0, len(part)])


ANCHOR = pa.schema([("hash", pa.int64()), ("doc_id", pa.int64()), ("times", pa.int64()), ("salt", pa.int32())])


def common_apart(h: np.ndarray, ids: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """ANCHOR rows of (hash, doc_id, times). Rows of an anchor that is hot among these alone are told apart by a salt above 0, as no count
    is needed to know them; one row with their sum, without an id, goes to the others of that anchor.
    """
    order = np.argsort(h, kind="stable")
    edge = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
    total = np.add.reduceat(times[order], edge)
    often = total > HOT
    which = order[np.repeat(often, np.diff(np.append(edge, len(h))))]
    salt = np.zeros(len(h), np.int32)
    salt[which] = 1 + (mixed(ids[which].view(np.uint64)) % np.uint64(SALTS)).astype(np.int32)
    extra = int(often.sum())
    columns = [
        pa.array(np.append(h, h[order[edge[often]]]).view(np.int64)),
        pa.array(np.append(ids, np.zeros(extra, np.int64)), mask=np.arange(len(ids) + extra) >= len(ids)),
        pa.array(np.append(times, total[often])),
        pa.array(np.append(salt, np.zeros(extra, np.int32))),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=ANCHOR)


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's anchors, once for each block of it, with how often they occur there; see ``common_apart``."""
    held, size = [], 0
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, _, _, part, cuts in blocks(data, offsets):
            first, _, h = anchors(part, cuts)
            row = np.searchsorted(cuts, first, "right") - 1
            order = np.lexsort((h, row))
            r, h = row[order], h[order]
            edge = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]))) if len(h) else NO_DATA
            held.append((h[edge], ids[lo + r[edge]], np.diff(np.append(edge, len(h))).astype(np.int64)))
            size += len(edge)
            if size >= HELD:
                yield common_apart(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
    if size:
        yield common_apart(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _in_order(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the keys, keys in that order) of keys below 2**bits. Where a key and its place fit one number, numbers are sorted, which is several times faster."""
    wide = len(key).bit_length()
    if bits + wide > 63:
        order = np.argsort(key)
        return order, key[order]
    both = np.sort(key << wide | np.arange(len(key)))
    return both & ((1 << wide) - 1), both >> wide


def suffix_array(symbols: np.ndarray, depth: int = LENGTH, shared: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of the ``depth`` symbols that start there, whether each differs from the one before it), by Larsson-Sadakane refinement: groups of equal prefixes
    are split by the rank of the place behind the prefix, which doubles the prefix, and groups of one are left alone.

    Symbols are 0 to 256; behind the end there are zeros. ``shared`` gets, for each suffix in order, a number of symbols that it shares with the one
    before it: more than half of all they share, unless that is less than seven.
    """
    n = len(symbols)
    bits = (n + 1).bit_length()
    known = min(7, max(1, (63 - bits) // 9))
    key = np.zeros(n, np.int64)
    wide = np.append(symbols.astype(np.int64), np.zeros(7, np.int64))
    for j in range(known):
        key = key << 9 | wide[j : j + n]
    sa, key = _in_order(key, 9 * known)
    new = np.append(True, key[1:] != key[:-1])
    rank = np.zeros(n + 2 * depth + 8, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    while known < depth:
        alone = new & np.append(new[1:], True)
        places = np.flatnonzero(~alone)
        if not len(places):
            break
        some = sa[places]
        order, key = _in_order(rank[some].astype(np.int64) << bits | rank[some + known], 2 * bits)
        some = some[order]
        sa[places] = some
        fresh = np.append(True, key[1:] != key[:-1])
        rank[some] = places[np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))] + 1
        if shared is not None:
            shared[places[fresh & ~new[places]]] = known
        new[places] = fresh
        known *= 2
    return sa, new


def common_prefixes(symbols: np.ndarray, sa: np.ndarray, new: np.ndarray, most: int = LENGTH, lanes: int = 1 << 14, shared: np.ndarray | None = None) -> np.ndarray:
    """Symbols (up to ``most``) that each suffix of the array shares with the one before it, by Kasai's rule: behind a
    place with h common symbols, the next has h - 1 at least. The text is cut into lanes, and all lanes advance a place at a time.
    The array is sorted to a depth only: places that it left equal have ``most`` symbols, and behind one of those the count starts anew.

    With ``shared`` (see ``suffix_array``), suffixes that surely share less than ``most`` are left at that number, and counting starts from it.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int16)
    todo = new & (np.arange(n) > 0)
    if shared is not None:
        out[sa] = shared
        todo &= 2 * shared.astype(np.int64) >= most
    out[sa[~new]] = most
    at = np.sort(sa[todo])
    if not len(at):
        return out[sa]
    wide = np.append(symbols.astype(np.int16), np.full(most + 1, -1, np.int16))
    # Seven symbols in one number: equal ones are stepped over at once. Behind the end nothing is equal, so the places differ.
    seven = np.zeros(n + most + 1, np.int64)
    seven[n:] = -np.arange(1, most + 2)
    inner = max(0, n - 6)
    for j in range(7):
        seven[:inner] = seven[:inner] << 9 | wide[j : inner + j]
    seven[inner:n] = -np.arange(most + 2, most + 2 + n - inner)
    stride = -(-len(at) // lanes)
    base = np.arange(0, len(at), stride)
    gap = np.diff(at, prepend=-most)
    h = np.zeros(len(base), np.int64)
    for t in range(stride):
        turn = base[base + t < len(at)] + t
        i = at[turn]
        j = before[i]
        h = np.maximum(h[: len(i)] - gap[turn], out[i]) if t else out[i].astype(np.int64)
        todo = np.arange(len(i))
        while len(todo):
            todo = todo[(seven[i[todo] + h[todo]] == seven[j[todo] + h[todo]]) & (h[todo] + 7 <= most)]
            h[todo] += 7
        todo = np.flatnonzero(h < most)
        while len(todo):
            # Behind the end of the text there is nothing equal: the later of two places ends first.
            same = wide[i[todo] + h[todo]] == wide[j[todo] + h[todo]]
            todo = todo[same & (np.maximum(i[todo], j[todo]) + h[todo] < n)]
            h[todo] += 1
            todo = todo[h[todo] < most]
        out[i] = h
    return out[sa]


#: Rows without bytes are windows that are removed. With ``windows`` = 0, a row is one window under a hot anchor: its route and bytes are two hashes of it.
SLICE_DDL = "route long, doc_id long, start long, windows int, bytes binary"
SLICE = pa.schema([("route", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("bytes", pa.binary())])


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the slices, one after the other."""
    ends = np.append(0, np.cumsum(sizes))
    return data[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])], ends


def _bare(route: np.ndarray, ids: np.ndarray, starts: np.ndarray, number: np.ndarray, check: np.ndarray | None = None) -> pa.RecordBatch:
    """SLICE rows without bytes, or with the 64 bits of ``check``."""
    held = pa.nulls(len(ids), pa.binary()) if check is None else pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.arange(0, 8 * len(ids) + 1, 8, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(check))])
    return pa.RecordBatch.from_arrays([pa.array(route), pa.array(ids), pa.array(starts), pa.array(number.astype(np.int32)), held], schema=SLICE)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Shard:
    """Runs of windows with a repeated anchor, as (doc_id, place in the document, bytes); sorted and emptied when full."""

    def __init__(self) -> None:
        self.ids, self.starts, self.parts, self.anchors = [], [], [], []
        self.size = 0

    def add(self, ids: np.ndarray, data: np.ndarray, cuts: np.ndarray, shift: int, runs: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> None:
        """runs: first window, windows, hash, hotness and row of repeated anchors of a block, in order."""
        first, number, h, hot, row = runs
        stop = first + number + LENGTH - 1
        # Runs whose bytes touch are one stretch of text.
        new = np.append(True, (first[1:] > stop[:-1]) | (row[1:] != row[:-1]))
        at = np.flatnonzero(new)
        lo, hi = first[at], np.maximum.reduceat(stop, at)
        text, ends = _gather(data, lo, hi - lo)
        stretch = np.cumsum(new) - 1
        self.ids.append(ids[row[at]])
        self.starts.append(lo - cuts[row[at]] + shift)
        self.parts.append((text, ends))
        self.anchors.append((stretch, first - lo[stretch], number, h, hot))
        self.size += len(text)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        ids, starts = np.concatenate(self.ids), np.concatenate(self.starts)
        sizes = np.concatenate([np.diff(e) for _, e in self.parts])
        text = np.concatenate([t for t, _ in self.parts])
        many = np.cumsum([0, *(len(e) - 1 for _, e in self.parts)])[:-1]
        stretch, inner, number, h, hot = (np.concatenate(x) for x in zip(*[(s + m, *rest) for (s, *rest), m in zip(self.anchors, many, strict=True)], strict=True))
        # Stretches in order of (doc_id, start), each with a gap behind it: an earlier place in the shard is an earlier one in the corpus.
        order = np.lexsort((starts, ids))
        seat = np.zeros(len(order), np.int64)
        seat[order] = np.append(0, np.cumsum(sizes[order] + 1))[:-1]
        old = np.append(0, np.cumsum(sizes))[:-1]
        symbols = np.zeros(int(sizes.sum()) + len(sizes), np.int16)
        to = np.repeat(seat - old, sizes) + np.arange(len(text))
        symbols[to] = text.astype(np.int16) + 1
        owner = np.zeros(len(symbols), np.int64)
        owner[to] = np.repeat(np.arange(len(sizes)), sizes)
        room = np.zeros(len(symbols), np.int64)
        room[to] = np.repeat(seat + sizes, sizes) - to
        shared = np.zeros(len(symbols), np.int16)
        sa, new = suffix_array(symbols, shared=shared)
        whole = room[sa] >= LENGTH
        equal = common_prefixes(symbols, sa, new, shared=shared) >= LENGTH
        group = np.cumsum(~equal) - 1
        edge = np.flatnonzero(~equal)
        earliest = np.minimum.reduceat(np.where(whole, sa, len(sa)), edge)[group]
        place = starts[owner] + np.arange(len(symbols)) - seat[owner]
        least = np.minimum(earliest, len(sa) - 1)
        later = whole & ((ids[owner[sa]] != ids[owner[least]]) | (place[sa] != place[least]))
        removed, kept = np.zeros(len(symbols), bool), np.zeros(len(symbols), bool)
        removed[sa[later]] = True
        kept[sa[whole & (sa == earliest)]] = True
        lo, hi = _runs(removed)
        d = ids[owner[lo]]
        yield _bare(d, d, place[lo], hi - lo)
        # Earliest windows go on: in runs under their anchor, or where that is hot each under its own hash.
        base = seat[stretch] + inner
        many, ends = _gather(kept.view(np.uint8), base, number)
        flag = np.zeros(len(many) + len(number) + 1, np.uint8)
        spread = np.repeat(np.arange(len(number)), number) + np.arange(len(many))
        flag[spread] = many
        lo, hi = _runs(flag)
        run = np.searchsorted(ends[:-1] + np.arange(len(number)), lo, "right") - 1
        at, number = base[run] + lo - ends[run] - run, hi - lo
        data = (symbols - 1).astype(np.uint8)
        hot = hot[run]
        text, cuts = _gather(data, at[hot], number[hot] + LENGTH - 1)
        spread = np.repeat(np.arange(len(cuts) - 1), number[hot])
        inner = np.arange(len(spread)) - np.repeat(np.cumsum(number[hot]) - number[hot], number[hot])
        anchor, seats = h[run][hot][spread], at[hot][spread] + inner
        route = _mix(window_hashes(text)[cuts[spread] + inner], anchor).view(np.int64)
        # The second hash reads other values for the bytes.
        check = _mix(window_hashes(text, mixed)[cuts[spread] + inner], anchor)
        yield _bare(route, ids[owner[seats]], place[seats], np.zeros(len(seats)), check)
        at, number, run = at[~hot], number[~hot], run[~hot]
        text, cuts = _gather(data, at, number + LENGTH - 1)
        binary = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(text)])
        yield pa.RecordBatch.from_arrays([pa.array(h[run].view(np.int64)), pa.array(ids[owner[at]]), pa.array(place[at]), pa.array(number.astype(np.int32)), binary], schema=SLICE)


def shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text, hashes of repeated anchors): windows that are removed, without bytes, and each shard's earliest windows."""
    shard = Shard()
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
        lists = batch.column("repeated")
        some = np.flatnonzero(np.asarray(lists.is_valid()))
        # Texts without a repeated anchor are null here, so what lies together is what is needed.
        known, row = lists.drop_null().flatten().to_numpy().view(np.uint64), np.repeat(some, lists.drop_null().value_lengths().to_numpy())
        known = _mix(known, row.astype(np.uint64))
        order = np.argsort(known)
        known, heat = known[order], batch.column("hot").drop_null().flatten().to_numpy(zero_copy_only=False)[order]
        for lo, _, shift, part, cuts in blocks(data, offsets):
            first, number, h = anchors(part, cuts)
            row = np.searchsorted(cuts, first, "right") - 1
            key = _mix(h, (lo + row).astype(np.uint64))
            at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
            hit = known[at] == key if len(known) else np.zeros(len(key), bool)
            if hit.any():
                shard.add(ids[lo : lo + len(cuts) - 1], part, cuts, shift, (first[hit], number[hit], h[hit], heat[at[hit]], row[hit]))
            if shard.size >= SHARD_BYTES:
                yield from shard.rows()
                shard = Shard()
    yield from shard.rows()


def merge_slices(slices: pa.Table) -> pa.RecordBatch:
    """SLICE rows: windows of slices that are not the earliest of their like, without bytes. Only bytes decide what is equal.

    Of slices with the same bytes, one is sorted, and its windows find their like for all. Equal windows have one anchor, so suffixes are
    sorted behind the rank of their route: those of different anchors differ in the first bytes.
    """
    data, offsets = flat(slices.column("bytes"))
    route, ids, starts, number = (slices.column(c).to_numpy() for c in ("route", "doc_id", "start", "windows"))
    # By route and age: the earliest of equal windows comes first.
    order = np.lexsort((starts, ids, route))
    route, ids, starts, number, lo = route[order], ids[order], starts[order], number[order].astype(np.int64), offsets[:-1][order]
    code = slices.column("bytes").combine_chunks().dictionary_encode().indices.to_numpy()[order]
    model = np.zeros(len(code), np.int64)
    model[code[::-1]] = np.arange(len(code))[::-1]
    model = model[code]
    own = np.flatnonzero(model == np.arange(len(model)))
    size = number[own]
    base = np.append(0, np.cumsum(size))
    spread = np.repeat(np.arange(len(own)), size)
    inner = np.arange(base[-1]) - base[spread]
    rank = np.cumsum(np.append(False, route[1:] != route[:-1]))[own].astype(">u4")
    suffixes = np.empty((len(spread), 4 + LENGTH), np.uint8)
    suffixes[:, :4] = rank.view(np.uint8).reshape(-1, 4)[spread]
    # No byte of UTF-8 is 255, so bytes grow by one and none is the zero that ends a numpy string.
    suffixes[:, 4:] = np.lib.stride_tricks.sliding_window_view(data + np.uint8(1), LENGTH)[lo[own][spread] + inner]
    suffixes = suffixes.view(f"S{4 + LENGTH}")[:, 0]
    # Suffixes are sorted once, the earliest of equal ones first; then every window finds its like by binary search.
    by_bytes = np.argsort(suffixes, kind="stable")
    suffixes = suffixes[by_bytes]
    first = np.empty(len(by_bytes), np.int64)
    first[by_bytes] = by_bytes[np.searchsorted(suffixes, suffixes)]
    place = np.zeros(len(model), np.int64)
    place[own] = base[:-1]
    ends = np.append(0, np.cumsum(number))
    owner = np.repeat(np.arange(len(number)), number)
    at = np.arange(ends[-1]) - ends[owner]
    first = first[place[model[owner]] + at]
    of, behind = own[spread[first]], inner[first]
    later = (ids[owner] != ids[of]) | (starts[owner] + at != starts[of] + behind)
    flag = np.zeros(len(later) + len(number) + 1, np.uint8)
    flag[owner + np.arange(len(later))] = later
    lo, hi = _runs(flag)
    run = np.searchsorted(ends[:-1] + np.arange(len(number)), lo, "right") - 1
    return _bare(ids[run], ids[run], starts[run] + lo - ends[run] - run, hi - lo)


def merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SLICE rows of removed windows from a partition in order of route, for hot anchors second hash, doc_id and start. What is held are the slices of MERGED windows, and of
    an anchor that is not hot; of equal windows under hot anchors, which follow one another, only the first.
    """
    waiting, number = [], 0
    head = None
    for batch in batches:
        bare, size = np.asarray(batch.column("bytes").is_null()), batch.column("windows").to_numpy()
        yield batch.filter(pa.array(bare)).cast(SLICE)
        alone = batch.filter(pa.array(~bare & (size == 0)))
        bare |= size == 0
        if alone.num_rows:
            route, ids, starts = (alone.column(c).to_numpy() for c in ("route", "doc_id", "start"))
            check = np.frombuffer(flat(alone.column("bytes"))[0].tobytes(), np.uint64)
            same = (route[1:] == route[:-1]) & (check[1:] == check[:-1])
            new = np.append(head is None or head[:2] != (route[0], check[0]), ~same)
            first = np.maximum.accumulate(np.where(new, np.arange(len(route)), -1))
            of_id, of_start = ids[first], starts[first]
            if head is not None:
                of_id[first < 0], of_start[first < 0] = head[2:]
            later = (ids != of_id) | (starts != of_start)
            head = route[-1], check[-1], of_id[-1], of_start[-1]
            yield _bare(ids[later], ids[later], starts[later], np.ones(int(later.sum())))
        batch = batch.filter(pa.array(~bare))
        if not batch.num_rows:
            continue
        waiting.append(batch)
        number += int(batch.column("windows").to_numpy().sum())
        if number >= MERGED:
            held = pa.Table.from_batches(waiting)
            route = held.column("route").to_numpy()
            other = np.flatnonzero(route != route[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield merge_slices(held.slice(0, cut))
            rest = held.slice(cut)
            waiting, number = rest.to_batches(), int(rest.column("windows").to_numpy().sum())
    if waiting:
        yield merge_slices(pa.Table.from_batches(waiting))


def removed_windows(texts: DataFrame) -> DataFrame:
    """(doc_id, start, windows): runs of windows that also start earlier, from (doc_id, text) without null ids."""
    ddl = "hash long, doc_id long, times long, salt int"
    seen = texts.filter(F.octet_length("text") >= LENGTH).select("doc_id", "text").mapInArrow(anchor_rows, ddl)
    # One sort counts all anchors. The rows of a hot one are spread over salts, and each task sends their count in one row.
    salted = F.col("salt") > 0
    seen = seen.withColumn("all", F.sum("times").over(Window.partitionBy("hash", "salt"))).filter(F.col("doc_id").isNotNull() & (salted | (F.col("all") > 1)))
    seen = seen.withColumn("hot", salted | (F.col("all") > HOT))
    pairs = F.collect_set(F.struct("hash", "hot")).alias("pairs")
    repeated = seen.groupBy("doc_id").agg(pairs).select("doc_id", F.col("pairs.hash").alias("repeated"), F.col("pairs.hot").alias("hot"))
    joined = texts.join(repeated, "doc_id", "left")
    # All columns go along, so that this join and the last one read the same exchange.
    slices = joined.withColumn("text", F.when(F.col("repeated").isNotNull(), F.col("text"))).mapInArrow(shard_rows, SLICE_DDL)
    merged = slices.repartition("route").sortWithinPartitions("route", F.when(F.col("windows") == 0, F.col("bytes")), "doc_id", "start").mapInArrow(merge_rows, SLICE_DDL)
    return merged.select("doc_id", "start", "windows")


def cut_out(text: Column, windows: Column, as_text: bool = False) -> Column:
    """struct<kept, starts, lengths>: a text's bytes without the given array<struct<start, windows>>, and the runs that are removed.

    With ``as_text``, kept is a string; bytes of characters that were cut through fall out of it.
    """
    longs = T.ArrayType(T.LongType())
    kind = T.StructType([T.StructField("kept", T.StringType() if as_text else T.BinaryType()), T.StructField("starts", longs), T.StructField("lengths", longs)])

    @F.arrow_udf(kind)
    def cut(column: pa.Array, runs: pa.Array) -> pa.Array:
        data, offsets = flat(column)
        kept, starts, lengths, counts = [], [], [], [0]
        for i, run in enumerate(runs):
            t = data[offsets[i] : offsets[i + 1]]
            lo = hi = NO_DATA
            if run.is_valid and len(run):
                s, w = (np.asarray(run.values.field(k), np.int64) for k in ("start", "windows"))
                delta = np.zeros(len(t) + 1, np.int32)
                np.add.at(delta, s, 1)
                np.add.at(delta, s + w + LENGTH - 1, -1)
                gone = np.cumsum(delta[:-1]) > 0
                lo, hi = _runs(gone)
                t = t[~gone]
            kept.append(t.tobytes().decode("utf-8", "ignore") if as_text else t.tobytes())
            starts.append(lo)
            lengths.append(hi - lo)
            counts.append(counts[-1] + len(lo))
        at = pa.array(np.array(counts, np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x) if x else NO_DATA)) for x in (starts, lengths)]
        return pa.StructArray.from_arrays([pa.array(kept, pa.string() if as_text else pa.binary()), *lists], names=["kept", "starts", "lengths"])

    return cut(text, windows)


def remove_repeats(docs: DataFrame, carry: bool = False, as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, kept (bytes), starts and lengths of the removed runs of every document; with ``carry`` also ``carried``, a struct of all other columns;
    with ``as_text``, kept is a string without the bytes of characters that were cut through.

    Null and empty texts, and those under 100 bytes, keep all they have. Rows with one doc_id count as one document: none is earlier than the
    other, and what is removed is removed from each. Rows without a doc_id are left as they are. An empty table gives an empty
    result; other columns than doc_id and text are carried along or not read, whatever their names.
    """
    docs = in_small_batches(docs)
    # Under an alias of its own, a column that is long already would differ between the two joins, and each would shuffle the texts.
    number = F.col("doc_id") if docs.schema["doc_id"].dataType == T.LongType() else F.col("doc_id").cast("long").alias("doc_id")
    texts = docs.select(number, F.coalesce("text", F.lit("")).alias("text"))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    if carry and others:
        # In an array, no field is pruned on the way: both joins need the same columns to read one exchange.
        texts = docs.select(number, F.coalesce("text", F.lit("")).alias("text"), F.array(F.struct(*others)).alias("carried"))
    rest = [F.element_at("carried", 1).alias("carried")] if "carried" in texts.columns else []
    named = texts.filter("doc_id is not null")
    gone = removed_windows(named).groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows")).alias("windows"))
    nothing = F.lit(None).cast(gone.schema["windows"].dataType)
    # Rows without an id stay out of the joins, where they would all meet in one task.
    out = named.join(gone, "doc_id", "left").unionByName(texts.filter("doc_id is null").withColumn("windows", nothing))
    out = out.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), cut_out(F.col("text"), F.col("windows"), as_text).alias("c"), *rest)
    return out.select("doc_id", "n_bytes", "c.kept", "c.starts", "c.lengths", *(["carried"] if rest else []))
