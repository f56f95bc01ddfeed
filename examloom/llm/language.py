"""Operator 2, language identification by hierarchical discrimination.

The language family comes first: one linear support vector machine per family, one against the rest, and the
family with the greatest margin wins. Within a family, closely related languages are told apart by linear
support vector machines of each pair, which vote; the sum of margins breaks ties.

Features are byte n-grams of the lower-cased letters (anything else counts as a gap), hashed into a fixed number of
buckets and averaged over the whole text, so a margin is the mean of one weight per position.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from examloom.llm.batches import in_small_batches
from examloom.llm.labelled import remainder, sample
from examloom.llm.text_arrays import flat, pieces

#: Families of language codes. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "turkic": ("az", "kk", "ky", "tr", "tk", "uz"),
    "uralic": ("et", "fi", "hu"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}
BITS = 15
GRAMS = (1, 2, 3, 4)
BLOCK = 1 << 19
#: At most so many documents of each language are fitted, and so many bytes of their texts.
PER_LANGUAGE, LANGUAGE_BYTES = 600, 1 << 23
#: Margins grow by this factor before they become probabilities; features are small, as they are averages.
SHARPNESS = 4.0

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def family(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members), lang)


def gram_positions(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Buckets and rows of the n-grams within each row; runs of gaps count once."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    x = _FOLD[data]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32) | (row[1:] != row[:-1])
    x, row = x[keep].astype(np.uint64), row[keep]
    buckets, rows = [], []
    for g in GRAMS:
        n = len(x) - g + 1
        if n <= 0:
            continue
        h = np.full(n, g, np.uint64)
        for j in range(g):
            h = (h << np.uint64(8)) | x[j : j + n]
        ok = row[:n] == row[g - 1 :]
        buckets.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)[ok])
        rows.append(row[:n][ok])
    return buckets, rows


def bag(text: pa.Array) -> pa.Array:
    """Each text's n-gram counts as int32 (bucket, count) pairs, at most 2**BITS of them."""
    data, offsets = flat(text)
    out = [np.zeros(0, np.int64)] * len(text)
    counted = [np.zeros(0, np.int64)] * len(text)
    for block, cuts, rows in pieces(data, offsets, BLOCK):
        b, r = map(np.concatenate, gram_positions(block, cuts)) if len(block) else (np.zeros(0, int), np.zeros(0, int))
        key, n = np.unique(r << BITS | b, return_counts=True)
        for i, k in enumerate(rows):
            lo, hi = np.searchsorted(key, [i << BITS, (i + 1) << BITS])
            at, inverse = np.unique(np.concatenate([out[k], key[lo:hi] - (i << BITS)]), return_inverse=True)
            out[k], counted[k] = at, np.bincount(inverse, np.concatenate([counted[k], n[lo:hi]]), len(at)).astype(np.int64)
    return pa.array([np.stack([a, c], axis=1).astype(np.int32).tobytes() for a, c in zip(out, counted, strict=True)], pa.binary())


def linear_svm(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 8, c: float = 1.0, seed: int = 5) -> np.ndarray:
    """Dual coordinate descent for a hinge loss with an L2 penalty; x holds sparse rows, y is -1 or 1."""
    w, alpha = np.zeros((1 << BITS) + 1), np.zeros(len(x))
    weight = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    norm = np.array([v @ v + 1 for _, v in x])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            at, v = x[i]
            gradient = y[i] * (w[at] @ v + w[-1]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0), weight[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                w[-1] += (new - alpha[i]) * y[i]
                alpha[i] = new
    return w


@dataclass
class LanguageModel:
    """weights: one row of bucket weights per machine, families first, then the pairs within each family; bias likewise."""

    languages: list[str]
    families: list[str]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray


def train(bags: list[bytes], langs: list[str]) -> LanguageModel:
    rows = []
    for b in bags:
        pair = np.frombuffer(b, np.int32).reshape(-1, 2)
        v = np.sqrt(pair[:, 1] / max(1, pair[:, 1].sum()))
        rows.append((pair[:, 0], v))
    # The averages are linear in the counts; machines are trained on them at a common scale.
    scale = 30.0
    rows = [(at, scale * v * v) for at, v in rows]
    languages = sorted(set(langs))
    of = {lang: family(lang) for lang in languages}
    families = sorted(set(of.values()))
    pairs = [(a, b) for f in families for a, b in combinations([x for x in languages if of[x] == f], 2)]
    y = np.array(langs)
    machines = []
    for f in families:
        here = np.array([of[x] == f for x in langs])
        machines.append(linear_svm(rows, np.where(here, 1, -1)) if 0 < here.sum() < len(y) else np.r_[np.zeros(1 << BITS), 1.0])
    for a, b in pairs:
        pick = np.flatnonzero((y == a) | (y == b))
        machines.append(linear_svm([rows[i] for i in pick], np.where(y[pick] == a, 1, -1)))
    w = np.array(machines) if machines else np.zeros((0, (1 << BITS) + 1))
    return LanguageModel(languages, families, pairs, (scale * w[:, :-1]).astype(np.float32), w[:, -1])


def decide(model: LanguageModel, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Languages and scores (0 to 1) from margins, one row per text and a column per machine."""
    n, k = len(margins), len(model.families)
    best = np.argmax(margins[:, :k], axis=1) if k else np.zeros(n, int)
    e = np.exp(SHARPNESS * (margins[:, :k] - margins[:, :k].max(axis=1, keepdims=True))) if k else np.ones((n, 1))
    share = (e / e.sum(axis=1, keepdims=True))[np.arange(n), best]
    lang, score = np.full(n, "und", object), share.copy()
    for f, name in enumerate(model.families):
        members = [x for x in model.languages if family(x) == name]
        here = np.flatnonzero(best == f)
        votes, total = np.zeros((len(here), len(members))), np.zeros((len(here), len(members)))
        for j, (a, b) in enumerate(model.pairs):
            if a in members:
                m = margins[here, k + j]
                for x, sign in ((a, 1), (b, -1)):
                    votes[:, members.index(x)] += sign * m > 0
                    total[:, members.index(x)] += sign * m
        # Votes decide; squashed margins, which stay below half a vote, break ties.
        pick = np.argmax(votes + 0.49 * np.tanh(total), axis=1)
        lang[here] = np.array(members, object)[pick]
        if len(members) > 1:
            score[here] *= 1 / (1 + np.exp(-np.clip(SHARPNESS * total[np.arange(len(here)), pick] / (len(members) - 1), -40, 40)))
    return lang, score


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, language_bytes: int = LANGUAGE_BYTES) -> LanguageModel:
    """Fits on a bounded sample of the documents of each language, from rows with crc32(doc_id) mod 4 other than 2 and a lang; an id with several languages takes the greatest."""
    usable = in_small_batches(docs).select("doc_id", "lang", "text").filter((remainder("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    picked = sample(usable, usable.select("doc_id", "lang"), "lang", per_language, language_bytes)
    rows = picked.select("doc_id", F.col("label").alias("lang"), F.arrow_udf(bag, T.BinaryType())("text").alias("bag")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return train([bytes(r["bag"]) for r in rows], [r["lang"] for r in rows])


def predict(model: LanguageModel, text: Column) -> Column:
    """struct<lang_pred, score> of each whole text; ``und`` and 0 for null texts, and for those without a letter."""
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(kind)
    def predicted(column: pa.Array) -> pa.Array:
        data, offsets = flat(column)
        total, number = np.zeros((len(column), len(model.weights))), np.zeros(len(column))
        for block, cuts, rows in pieces(data, offsets, BLOCK):
            for b, r in zip(*gram_positions(block, cuts), strict=True):
                number[rows] += np.bincount(r, minlength=len(rows))
                for m, w in enumerate(model.weights):
                    total[rows, m] += np.bincount(r, w[b], len(rows))
        lang, score = decide(model, total / np.maximum(number, 1)[:, None] + model.bias)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])

    return predicted(text)


def identify_languages(docs: DataFrame) -> DataFrame:
    """Every document with its predicted language.

    Texts that are null or hold no letter give ``und`` with score 0. Of families with equal margins, the first by name is taken, and so is the
    first language where votes and sums of margins are equal. Repeated rows are predicted each; an empty
    table gives an empty result; only doc_id, text and lang are read, and lang only for training.
    """
    model = fit(docs)
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(model.languages))
    out = docs.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), lettered.alias("lettered"), predict(model, F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", F.when(F.col("lettered"), F.col("p.lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("lettered"), F.col("p.score")).otherwise(0.0).alias("score"))
