"""Operator 9, quality classifier: supervised subword embeddings.

A document is a bag of hashed features: its words, and byte n-grams of its text. Every feature owns a short vector; a
document's vector is the average over its features, and a softmax over the classes reads it. Vectors and
output weights are learned together by stochastic gradient descent in numpy, on a bounded sample of labelled rows.

Averaging is linear, so after training each feature's contribution to the log-odds is one number: scoring
gathers these numbers for all positions of the whole text and averages them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from examloom.llm.batches import in_small_batches
from examloom.llm.labelled import remainder, sample
from examloom.llm.text_arrays import byte_values, flat, pieces, span_hashes, words

BITS = 17
GRAMS = (3, 5)
BLOCK = 1 << 19
#: At most so many labelled documents of each class are fitted, and so many bytes of their texts.
PER_CLASS, CLASS_BYTES = 1500, 1 << 24


def feature_positions(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Buckets and rows of every word and every byte n-gram that lies within one row."""
    buckets, rows = [], []
    s, e, r = words(data, offsets)
    values = byte_values(data)
    buckets.append((span_hashes(values, s, e) >> np.uint64(64 - BITS)).astype(np.int64))
    rows.append(r)
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for g in GRAMS:
        n = len(data) - g + 1
        if n <= 0:
            continue
        h = np.zeros(n, np.uint64)
        for j in range(g):
            h = h * np.uint64(0x100000001B3) + values[j : j + n]
        ok = row_of[:n] == row_of[g - 1 :]
        buckets.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)[ok])
        rows.append(row_of[:n][ok])
    return buckets, rows


def bag(text: pa.Array) -> pa.Array:
    """A document's features as int32 (bucket, count) pairs: at most 2**BITS of them, however long the text."""
    data, offsets = flat(text)
    counts: dict[int, np.ndarray] = {}
    for block, cuts, row in pieces(data, offsets, BLOCK):
        b, r = feature_positions(block, cuts)
        b, r = np.concatenate(b), np.concatenate(r)
        key, n = np.unique(r * (1 << BITS) + b, return_counts=True)
        for i, k in enumerate(row):
            mine = slice(*np.searchsorted(key, [i << BITS, (i + 1) << BITS]))
            pair = np.stack([key[mine] - (i << BITS), n[mine]])
            if k in counts:
                both = np.concatenate([counts[k], pair], axis=1)
                at, inverse = np.unique(both[0], return_inverse=True)
                pair = np.stack([at, np.bincount(inverse, both[1]).astype(np.int64)])
            counts[k] = pair
    return pa.array([np.ascontiguousarray(counts[i].T, np.int32).tobytes() if i in counts else b"" for i in range(len(text))], pa.binary())


@dataclass
class SubwordClassifier:
    """contribution: each bucket's part of the log-odds of label 1; bias: what an empty text gets."""

    contribution: np.ndarray
    bias: float


def train(bags: list[bytes], labels: np.ndarray, dim: int = 8, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> SubwordClassifier:
    """Softmax regression over averaged feature vectors, one document a step, rate falling to nothing."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    docs = [np.frombuffer(b, np.int32).reshape(-1, 2) for b in bags]
    steps = max(1, epochs * len(docs))
    step = 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            lr = rate * (1 - step / steps)
            step += 1
            at, weight = docs[i][:, 0], docs[i][:, 1].astype(np.float32)
            if len(at):
                weight = weight / weight.sum()
            hidden = weight @ vectors[at] if len(at) else np.zeros(dim, np.float32)
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            if len(at):
                # As in subword classifiers, every feature takes the document's gradient, scaled by how often it occurs there.
                vectors[at] -= lr * np.outer(weight / weight.max(), p @ out)
            out -= lr * np.outer(p, hidden)
            bias -= np.float32(0.1 * lr) * p
    return SubwordClassifier((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> SubwordClassifier:
    """Fits on a bounded sample of labelled documents of the classes 0 and 1; ``docs`` needs doc_id and text, ``labels`` doc_id and the label."""
    picked = sample(in_small_batches(docs), labels.select("doc_id", label).filter(F.col(label).isin(0, 1)), label, per_class, class_bytes)
    bags = picked.select("doc_id", "label", F.arrow_udf(bag, T.BinaryType())("text").alias("bag"))
    # The sample is bounded, so one task learns from it; the driver gets the model alone, not the bags.
    rows = bags.repartition(1).mapInArrow(_learned, "contribution binary, bias double").collect()
    if not rows:
        return train([], np.zeros(0, np.int64))
    return SubwordClassifier(np.frombuffer(rows[0]["contribution"], np.float32), rows[0]["bias"])


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of (doc_id, label, bag), as a row."""
    rows = sorted((row for b in batches for row in b.to_pylist()), key=lambda r: r["doc_id"])
    model = train([r["bag"] for r in rows], np.array([int(r["label"]) for r in rows], np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([model.contribution.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], ["contribution", "bias"])


def score(model: SubwordClassifier, text: Column) -> Column:
    """Probability of label 1 for each text, read whole; null and empty texts get the bias alone."""
    contribution, bias = model.contribution, model.bias

    @F.arrow_udf(T.DoubleType())
    def scored(column: pa.Array) -> pa.Array:
        data, offsets = flat(column)
        total, number = np.zeros(len(column)), np.zeros(len(column))
        for block, cuts, row in pieces(data, offsets, BLOCK):
            for b, r in zip(*feature_positions(block, cuts), strict=True):
                total[row] += np.bincount(r, contribution[b], len(row))
                number[row] += np.bincount(r, minlength=len(row))
        z = total / np.maximum(number, 1) + bias
        return pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    return scored(text)


def training_labels(labels: DataFrame) -> DataFrame:
    """Label rows that models may learn from: crc32(doc_id) mod 5 is not 0."""
    return labels.filter(remainder("doc_id", 5) != 0)


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Every document with its quality score.

    Null and empty texts get the model's bias. Repeated rows are scored each; an empty table gives an empty
    result; other columns of ``docs`` are not read. Without labels of both classes the model knows only the bias.
    """
    model = fit(docs, training_labels(labels))
    return docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), score(model, F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
