"""Operator 3, toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text is cut into short windows,
each window is compressed under both, and the difference of the two lengths says which text it resembles. Four
statistics of a document's differences go through a calibrated logistic threshold.

Toxic documents are mostly ordinary prose, so a dictionary of their commonest strings would hold the same syllables
as the other. Its samples are therefore the stretches of toxic documents built from byte 5-grams that occur in
significantly more toxic than ordinary documents; both dictionaries end in the same trained block of ordinary
prose, so that what both know cancels out.

The threshold is calibrated on documents that the dictionaries never saw: each of FOLDS parts of the labelled sample is measured
with dictionaries of the other parts. The dictionaries in use then learn from all parts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from examloom.llm.batches import in_small_batches
from examloom.llm.labelled import remainder, sample
from examloom.llm.quality import training_labels
from examloom.llm.text_arrays import LOWER, flat

WINDOW = 64
LEVEL = 9
GRAM = 5
#: At most so many labelled documents of each class are fitted, and so many bytes of their texts.
PER_CLASS, CLASS_BYTES = 1500, 1 << 23
#: Bytes of the block that both dictionaries end in, and of what each has of its own.
SHARED, OWN = 110_000, 2_048
#: All ordinary prose of the sample is cut into pieces of about so many bytes for the shared block, and these into pieces of about the length of a telling stretch for the ordinary dictionary's own part.
PROSE, STRETCH = 128, 24
FOLDS = 2


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """The whole text in runs of at least ``size`` bytes that end behind a space; a run without one is cut at twice the size."""
    out, at, n = [], 0, len(text)
    while at < n:
        cut = text.find(b" ", at + size, at + 2 * size) + 1 or min(n, at + 2 * size)
        out.append(text[at:cut])
        at = cut
    return out


@dataclass
class ToxicityModel:
    """The two dictionaries' bytes; statistics' means, deviations and weights, and the bias."""

    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    deviation: np.ndarray
    weight: np.ndarray
    bias: float

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        """Built where they are used: they can't be sent to tasks."""
        out = []
        for raw in (self.toxic, self.ordinary):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out


def statistics(text: bytes, toxic: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor) -> list[float]:
    d = np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(text)] or [0], float)
    d.sort()
    return [d[-1], d.mean(), d[-3:].mean(), (d >= 3).mean()]


def gram_codes(text: bytes) -> np.ndarray:
    """The lower-cased text's GRAM bytes at every place, as one number each."""
    x = LOWER[np.frombuffer(text, np.uint8)].astype(np.uint64)
    n = max(0, len(x) - GRAM + 1)
    codes = np.zeros(n, np.uint64)
    for j in range(GRAM):
        codes = codes << np.uint64(8) | x[j : n + j]
    return codes


def document_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, number of texts that hold each)."""
    held = [np.unique(gram_codes(t)) for t in texts]
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)


def telling_grams(toxic: list[bytes], ordinary: list[bytes], least: float = 6.0) -> np.ndarray:
    """Codes, in order, of the 5-grams whose share of toxic documents exceeds their share of ordinary ones by ``least`` standard errors."""
    (grams, k), (others, counts) = document_counts(toxic), document_counts(ordinary)
    at = np.minimum(np.searchsorted(others, grams), max(0, len(others) - 1))
    m = np.where(others[at] == grams, counts[at], 0) if len(others) else np.zeros(len(grams), int)
    a, b = max(1, len(toxic)), max(1, len(ordinary))
    return grams[(k >= 5) & (k / a - m / b > least * np.sqrt((k + m + 1) / (a + b) * (1 / a + 1 / b)))]


def telling_stretches(text: bytes, grams: np.ndarray) -> list[bytes]:
    """The runs of a text that are covered by ``grams``, but for gaps of up to two places, with a byte on both sides."""
    hits = np.flatnonzero(np.isin(gram_codes(text), grams))
    if not len(hits):
        return []
    ends = np.append(np.flatnonzero(np.diff(hits) > 2), len(hits) - 1)
    starts = np.append(0, ends[:-1] + 1)
    return [text[max(0, a - 1) : b + GRAM + 1] for a, b in zip(hits[starts].tolist(), hits[ends].tolist(), strict=True)]


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[:size]


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent with a small penalty; both classes weigh the same."""
    w, b = np.zeros(x.shape[1]), 0.0
    each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(steps):
        g = (1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40))) - y) * each
        w, b = w - rate * 4 * (x.T @ g + 1e-3 * w), b - rate * 4 * g.sum()
    return w, b


def dictionaries(toxic: list[bytes], ordinary: list[bytes], rng: np.random.Generator) -> ToxicityModel:
    """A model without a calibration."""
    prose = [w for t in ordinary for w in windows(t, PROSE)]
    prose = [prose[i] for i in rng.permutation(len(prose))]
    grams = telling_grams(toxic, ordinary)
    found = [s for t in toxic for s in telling_stretches(t, grams)]
    found = [found[i] for i in rng.permutation(len(found))]
    shared = dictionary(prose, SHARED)
    told = dictionary([b"".join(found[i : i + 4]) for i in range(0, len(found), 4)], OWN)
    plain = dictionary([w[i : i + STRETCH] for w in prose for i in range(0, len(w), STRETCH)], OWN)
    return ToxicityModel(told + shared or b" ", plain + shared or b" ", np.zeros(4), np.ones(4), np.zeros(4), 0.0)


def train(toxic: list[bytes], ordinary: list[bytes], prior: float, seed: int = 3) -> ToxicityModel:
    """Dictionaries of all texts, calibrated on statistics of texts under dictionaries of the other folds; ``prior`` is the share of toxic labels."""
    rng = np.random.default_rng(seed)
    x, y = [], []
    for fold in range(FOLDS):
        rest = [[t for i, t in enumerate(side) if i % FOLDS != fold] for side in (toxic, ordinary)]
        pair = dictionaries(*rest, rng).compressors()
        for label, side in ((1, toxic), (0, ordinary)):
            x += [statistics(t, *pair) for t in side[fold::FOLDS]]
            y += [label] * len(side[fold::FOLDS])
    x, y = np.array(x or [[0.0] * 4]), np.array(y or [0])
    model = dictionaries(toxic, ordinary, rng)
    model.mean, model.deviation = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.weight, model.bias = logistic((x - model.mean) / model.deviation, y)
    model.bias += float(np.log(prior / (1 - prior)))
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> ToxicityModel:
    """Fits on a bounded sample of labelled documents of the classes 0 and 1, of any length; the prior is counted over all labels."""
    labels = labels.select("doc_id", label).filter(F.col(label).isin(0, 1))
    counts = {r[label]: r["n"] for r in labels.groupBy(label).agg(F.count("*").alias("n")).collect()}
    rows = sample(in_small_batches(docs), labels, label, per_class, class_bytes).select("doc_id", "label", F.encode("text", "UTF-8").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    sides = [[bytes(r["text"]) for r in rows if r["label"] == c] for c in (1, 0)]
    total = max(1, counts.get(0, 0) + counts.get(1, 0))
    return train(*sides, prior=min(0.9, max(0.02, counts.get(1, 0) / total)))


_PAIRS: dict[bytes, list[zstandard.ZstdCompressor]] = {}


def _pair(model: ToxicityModel) -> list[zstandard.ZstdCompressor]:
    """A worker's compressors: of one model, as each pair takes some MB."""
    key = model.toxic + model.ordinary
    if key not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[key] = model.compressors()
    return _PAIRS[key]


def score(model: ToxicityModel, text: Column) -> Column:
    """Probability of toxicity of each whole text; null and empty texts have the one difference 0."""

    @F.arrow_udf(T.DoubleType())
    def scored(column: pa.Array) -> pa.Array:
        pair = _pair(model)
        data, offsets = flat(column)
        x = np.array([statistics(data[a:b].tobytes(), *pair) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]).reshape(-1, 4)
        z = ((x - model.mean) / model.deviation) @ model.weight + model.bias
        return pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    return scored(text)


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every document with its toxicity score.

    Null and empty texts are scored as a text whose windows tell nothing. Repeated rows are scored each; an empty table
    gives an empty result; other columns of ``docs`` are not read. Without toxic labels the score is the prior's.
    """
    model = fit(docs, training_labels(labels))
    return docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), score(model, F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
