"""Operator 12, resampling documents towards a target distribution by importance weights over hashed features.

Two passes over the texts, both in Arrow batches. The first counts each partition's features by bucket with ``np.bincount``;
the partitions' vectors, of ``buckets`` numbers each, are merged by ``treeReduce``. A bucket's gain is the log ratio of
its share in the target and in the corpus. The second pass gathers the broadcast gains, of the same fixed size, and sums
them for each document with the weights of ``np.bincount``. Documents are then ordered by weight plus Gumbel noise
from their ids, which draws them without replacement in proportion to their weights.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from examloom.llm.batches import in_small_batches
from examloom.order import ranked
from examloom.llm.text_arrays import LOWER, flat, groups
from examloom.storage import materialize

BUCKETS = 10_000
#: Documents of fewer words are never drawn.
FEWEST_WORDS = 20
#: Weights, gains and noise are whole numbers of this part of a nat.
SCALE = 1000
#: Bytes of text that are handled at once; a longer text comes alone.
BLOCK = 1 << 21
#: Features of more bytes are hashed one by one.
LONG = 64
#: A word's bytes after lower-casing: digits, letters and everything outside ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of data[start:end] for all spans: the k-th bytes of all spans that have one go together."""
    sizes = ends - starts
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(-np.minimum(sizes, LONG + 1).astype(np.int16), kind="stable")
    n_long = int((sizes > LONG).sum())
    for i in order[:n_long].tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    order = order[n_long:]
    if len(order):
        at, falling = starts[order], -sizes[order]
        crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
        for k in range(int(sizes[order[0]])):
            m = int(np.searchsorted(falling, -k, "left"))
            crc[:m] = CRC[(crc[:m] ^ data[at[:m] + k]) & 0xFF] ^ (crc[:m] >> 8)
        out[order] = ~crc
    return out


def features(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, its row, words of each row) of rows of UTF-8 bytes. Features are runs of 1 to ``longest`` words of a row, joined by a space."""
    rows = len(offsets) - 1
    data = LOWER[data]
    inside = WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.append(False, inside[:-1]) & ~edge[:-1] if len(data) else np.zeros(0, bool)
    starts = np.flatnonzero(inside & ~before)
    after = np.append(inside[1:], False) & ~edge[1:] if len(data) else np.zeros(0, bool)
    ends = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    n_words = np.bincount(row, minlength=rows)
    if longest > 1 and len(starts):
        # One space stands behind each word, whatever stood there.
        sizes = ends - starts
        at = np.append(0, np.cumsum(sizes + 1))
        data = data[np.minimum(np.repeat(starts - at[:-1], sizes + 1) + np.arange(at[-1]), len(data) - 1)]
        data[at[1:] - 1] = 32
        starts, ends = at[:-1], at[1:] - 1
    found, owner = [], []
    for n in range(1, longest + 1):
        m = max(0, len(starts) - n + 1)
        same = row[:m] == row[n - 1 : n - 1 + m]
        found.append(crc32_spans(data, starts[:m][same], ends[n - 1 : n - 1 + m][same]) % np.uint32(buckets))
        owner.append(row[:m][same])
    return np.concatenate(found).astype(np.int64), np.concatenate(owner), n_words


def bucket_counts(texts: DataFrame, column: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for lo, hi in groups(offsets, BLOCK):
                found, _, _ = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], longest, buckets)
                total += np.bincount(found, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    context = texts.sparkSession.sparkContext
    vectors = in_small_batches(texts).select(F.col(column).cast("string").alias("text")).mapInArrow(counted, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    return vectors.union(context.parallelize([np.zeros(buckets, np.int64)], 1)).treeReduce(lambda a, b: a + b, depth=3)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a document's weight: the log of its smoothed share in the target over that in the corpus."""
    buckets, in_corpus, in_target = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = lambda s, t: ((t + 1.0) * (in_corpus + buckets)) / ((s + 1.0) * (in_target + buckets))
    return np.array([math.floor(SCALE * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = 1) -> Column:
    """struct<n_features, n_words, weight> of each text; ``weight`` is the floored mean of its features' gains, 0 without any."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    kind = T.StructType([T.StructField(c, T.LongType()) for c in ("n_features", "n_words", "weight")])

    @F.arrow_udf(kind)
    def weighed(column: pa.Array) -> pa.Array:
        gain = shared.value
        data, offsets = flat(column)
        out = np.zeros((3, len(column)), np.int64)
        for lo, hi in groups(offsets, BLOCK):
            found, owner, n_words = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], longest, len(gain))
            n = np.bincount(owner, minlength=hi - lo)
            total = np.bincount(owner, weights=gain[found], minlength=hi - lo).astype(np.int64)
            out[:, lo:hi] = n, n_words, total // np.maximum(n, 1)
        return pa.StructArray.from_arrays([pa.array(x) for x in out], names=[f.name for f in kind])

    return weighed(F.col("text"))


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise from the hash of seed and id; a null id counts as an empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, seed: str = "2024", longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document, all long; ``rank`` is null where a document isn't drawn.

    Of the N documents with FEWEST_WORDS words or more, floor(percent * N / 100) are drawn: those of the highest scores, ties
    to the smaller id. A null text has no features and a null id the noise of an empty id; null ids come before others in ties. Repeated
    rows are documents of their own, and equal ones follow one another in any order. An empty corpus gives an empty result, an empty target one weight per
    bucket as if nothing were known of it. Only doc_id and text are read.
    """
    gain = gains(bucket_counts(docs, "text", longest, buckets), bucket_counts(target, "text", longest, buckets))
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), weigh(docs, gain, longest).alias("w")).select("doc_id", "w.*")
    rows = materialize(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    fit = F.col("n_words") >= FEWEST_WORDS
    placed, n = ranked(rows.filter(fit), [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features").asc()])
    drawn = percent * n // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    chosen = placed.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return chosen.unionByName(rows.filter(~fit).select(*columns, F.lit(None).cast("long").alias("rank")))
