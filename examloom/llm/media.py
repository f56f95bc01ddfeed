"""Operator 7, media columns: ISO media containers.

``mux`` stores a payload losslessly as 8-bit unsigned PCM in an ISO media file; ``walk`` goes through nested boxes
of any such file, and ``tracks`` decodes its sample tables into codec, duration and the byte ranges of key frames, all
without decoding a payload. Files are columns: one binary value each, handled where Spark put the row.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from examloom.llm.batches import in_small_batches
from examloom.llm.text_arrays import flat

#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
#: Boxes nested deeper than this are not gone into; the deepest standard ones lie at six.
DEPTH = 16
RATE = 8000
#: One sample is a block of so many bytes; payloads are padded to a multiple of it.
UNIT = 64
#: Samples of a chunk: the file keeps a payload in runs of this many samples.
PER_CHUNK = 1024
_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(payload: bytes) -> bytes:
    """Zeros up to a positive multiple of UNIT bytes."""
    return payload + bytes(-len(payload) % UNIT or (0 if payload else UNIT))


def mux(payload: bytes, rate: int = RATE) -> bytes:
    """An ISO media file with one audio track of 8-bit mono PCM; every sample of it can be read alone.

    The media data stands in front of the tables, so that chunk offsets don't depend on the tables' size.
    """
    n = len(payload) // UNIT
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp42")
    mdat = box(b"mdat", payload)
    first = len(ftyp) + len(mdat) - len(payload)
    chunks = range(0, n, PER_CHUNK)
    offsets = [first + c * UNIT for c in chunks]
    wide = bool(offsets) and offsets[-1] >= 1 << 32
    last = n - chunks[-1] if n else 0
    runs = [] if not n else [(1, PER_CHUNK, 1)] * (len(offsets) > 1) + [(len(offsets), last, 1)]
    entry = box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, rate << 16))
    table = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, n, UNIT)),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", UNIT, n)),
        full(b"co64" if wide else b"stco", struct.pack(">I", len(offsets)), np.array(offsets, ">u8" if wide else ">u4").tobytes()),
    )
    length = n * UNIT
    head = struct.pack(">QQIQ", 0, 0, rate, length)
    moov = box(
        b"moov",
        full(b"mvhd", head, struct.pack(">IH10x", 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2), version=1),
        box(
            b"trak",
            full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, length, 0, 0, 0x100, 0), _MATRIX, bytes(8), version=1, flags=7),
            box(
                b"mdia",
                full(b"mdhd", head, struct.pack(">HH", 0x55C4, 0), version=1),
                full(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0"),
                box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table),
            ),
        ),
    )
    return ftyp + mdat + moov


def walk(data: bytes, lo: int = 0, hi: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, body end) of every box, outer boxes first; a box that runs over its parent ends the walk there."""
    hi = len(data) if hi is None else hi
    while lo + 8 <= hi:
        size, kind = struct.unpack_from(">I4s", data, lo)
        body = lo + 8
        if size == 1 and lo + 16 <= hi:
            size, body = struct.unpack_from(">Q", data, body)[0], lo + 16
        end = hi if size == 0 else lo + size
        if end > hi or end < body:
            return
        yield (*path, kind), body, end
        if kind in CONTAINERS and len(path) < DEPTH:
            yield from walk(data, body, end, (*path, kind))
        lo = end


class Damaged(ValueError):
    """A table that does not fit its box, its track or the file."""


def _field(data: bytes, form: str, at: int, end: int) -> tuple:
    if at + struct.calcsize(form) > end:
        raise Damaged("a box is too short for its fields")
    return struct.unpack_from(form, data, at)


def _table(data: bytes, box: tuple[int, int], dtype: str, width: int) -> np.ndarray:
    """The entries of a counted table behind version, flags and count."""
    body, end = box
    n = _field(data, ">I", body + 4, end)[0]
    if n * width * np.dtype(dtype).itemsize > end - body - 8:
        raise Damaged("a table has fewer entries than it says")
    return np.frombuffer(data, dtype, n * width, body + 8).reshape(n, width).astype(np.int64)


def sample_ranges(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(file offset, size) of every sample, from the chunk, size and offset tables. All samples lie within the file, so counts are held against its length."""
    body, end = boxes[b"stsz"]
    same, n = _field(data, ">II", body + 4, end)
    if n * (same or 4) > (len(data) if same else end - body - 12):
        raise Damaged("more samples than the file has room for")
    sizes = np.full(n, same, np.int64) if same else np.frombuffer(data, ">u4", n, body + 12).astype(np.int64)
    kind = b"co64" if b"co64" in boxes else b"stco"
    chunks = _table(data, boxes[kind], ">u8" if kind == b"co64" else ">u4", 1)[:, 0]
    runs = _table(data, boxes[b"stsc"], ">u4", 3)
    if not n:
        return np.zeros(0, np.int64), sizes
    lengths = np.diff(np.append(runs[:, 0] - 1, len(chunks)))
    if not len(chunks) or not len(runs) or runs[0, 0] != 1 or (lengths < 0).any() or (runs[:, 1] > n).any() or (runs[:, 1] * lengths).sum() != n:
        raise Damaged("chunks do not hold the samples")
    per_chunk = np.repeat(runs[:, 1], lengths)
    chunk_of = np.repeat(np.arange(len(chunks)), per_chunk)
    before = np.cumsum(sizes) - sizes
    first = (np.cumsum(per_chunk) - per_chunk)[chunk_of]
    starts = chunks[chunk_of] + before - before[first]
    if (starts < 0).any() or (starts + sizes > len(data)).any():
        raise Damaged("a sample lies outside the file")
    return starts, sizes


def _track(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> dict:
    at, end = boxes[b"mdhd"]
    wide = bool(_field(data, ">B", at, end)[0])
    scale, duration = _field(data, ">IQ" if wide else ">II", at + (20 if wide else 12), end)
    starts, sizes = sample_ranges(data, boxes)
    keys = _table(data, boxes[b"stss"], ">u4", 1)[:, 0] - 1 if b"stss" in boxes else np.arange(len(starts))
    if len(keys) and (keys.min() < 0 or keys.max() >= len(starts)):
        raise Damaged("a key frame is no sample")
    s, e = starts[keys], starts[keys] + sizes[keys]
    edge = np.flatnonzero(np.r_[True, s[1:] != e[:-1]]) if len(s) else np.zeros(0, int)
    ranges = np.stack([s[edge], np.maximum.reduceat(e, edge)], axis=1).tolist() if len(s) else []
    name = boxes[b"stsd"][0] + 12
    codec = _field(data, ">4s", name, boxes[b"stsd"][1])[0].decode("latin-1").strip()
    return {"codec": codec, "timescale": scale, "duration": duration, "samples": len(starts), "keyframes": len(keys), "ranges": ranges}


def tracks(data: bytes) -> list[dict]:
    """Codec, duration and key-frame byte ranges of each track; adjacent key frames are one range.

    A track without all its tables is left out. One whose tables do not fit together, or not the file, is {"damaged": why}.
    """
    found: list[dict[bytes, tuple[int, int]]] = []
    for path, body, end in walk(data):
        if path == (b"moov", b"trak"):
            found.append({})
        elif found and path[:2] == (b"moov", b"trak"):
            found[-1].setdefault(path[-1], (body, end))
    out = []
    for boxes in found:
        if not {b"stsd", b"stsz", b"stsc", b"mdhd"} <= boxes.keys() or not {b"stco", b"co64"} & boxes.keys():
            continue
        try:
            out.append(_track(data, boxes))
        except Damaged as why:
            out.append({"damaged": str(why)})
    return out


def payload(data: bytes) -> bytes:
    """The first track's sample bytes, in order; none of a damaged track."""
    return b"".join(data[a:b] for t in tracks(data)[:1] for a, b in t.get("ranges", ()))


def _mux_column(text: pa.Array) -> pa.Array:
    data, offsets = flat(text)
    raw = data.tobytes()
    return pa.array([mux(padded(raw[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())


def _read_column(media: pa.Array) -> pa.Array:
    files = [m.as_py() or b"" for m in media]
    features = [json.dumps(tracks(f), separators=(",", ":")) for f in files]
    return pa.StructArray.from_arrays([pa.array(map(payload, files), pa.binary()), pa.array(features, pa.string())], names=["payload", "feature"])


READ = T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType())])


def store_texts(text: Column) -> Column:
    """Each text's UTF-8 (null: empty), padded, as an ISO media file."""
    return F.arrow_udf(_mux_column, T.BinaryType())(text)


def read_media(media: Column) -> Column:
    """struct<payload, feature> of each file; feature is JSON, a list with an object per track. A null or cut file, or one without tracks, has an empty payload and
    no tracks; damaged tables are told in the feature, and never fail a task or take more memory than the file."""
    return F.arrow_udf(_read_column, READ)(media)


def _both_columns(text: pa.Array) -> pa.Array:
    media = _mux_column(text)
    payload, feature = _read_column(media).flatten()
    return pa.StructArray.from_arrays([media, payload, feature], names=["media", "payload", "feature"])


def store_and_read(text: Column) -> Column:
    """struct<media, payload, feature>: ``store_texts`` and ``read_media`` of its bytes in one function, so that a file is made once."""
    return F.arrow_udf(_both_columns, T.StructType([T.StructField("media", T.BinaryType()), *READ]))(text)


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the stored media and what reading it back gives.

    Null and empty texts are one block of zeros. Repeated rows give repeated rows, an empty table an empty one; other columns aren't read.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    stored = in_small_batches(docs).select("doc_id", size.alias("n_bytes"), store_and_read(F.col("text")).alias("r"))
    return stored.select("doc_id", "n_bytes", "r.media", "r.payload", "r.feature")
