"""Operator 12 against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from examloom.llm import importance
from examloom.order import ranked

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text: str | None, longest: int = 1) -> tuple[list[int], int]:
    words = WORDS.findall((text or "").translate(UPPER))
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def plainly(docs: list[tuple], target: list, longest: int = 1, percent: int = 10) -> list[tuple]:
    found = [plain_features(t, longest) for _, t in docs]
    s, t = [0] * 10000, [0] * 10000
    for f, _ in found:
        for b in f:
            s[b] += 1
    for x in target:
        for b in plain_features(x, longest)[0]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for (i, _), (f, n) in zip(docs, found, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    drawn = percent * len(order) // 100
    return sorted([(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(order)] + [(*r[:4], None) for r in rows if not r[4]], key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("aZ09 .é\x00\x7f", max_size=60)), max_size=8), st.integers(1, 3))
def test_features(texts, longest):
    raw = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(b) for b in raw])).astype(np.int64)
    found, owner, n_words = importance.features(np.frombuffer(b"".join(raw), np.uint8), offsets, longest, 10000)
    want = [plain_features(t, longest) for t in texts]
    assert n_words.tolist() == [n for _, n in want]
    for i, (f, _) in enumerate(want):
        assert sorted(found[owner == i].tolist()) == sorted(f)


def test_long_words():
    raw = b"x" * 100_000 + b" short " + b"y" * 65 + b" " + b"z" * 64
    found, _, n = importance.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 1, 10000)
    assert found.tolist() == [zlib.crc32(w) % 10000 for w in raw.split()] and n.tolist() == [4]


def test_resample(spark, odd, none):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    target = ["X x one two", None, "", docs[0][1]]
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    for longest, percent in ((1, 10), (2, 60), (1, 100)):
        got = importance.resample(odd, goal, percent, longest=longest).collect()
        rows = [(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got]
        assert sorted(rows, key=str) == plainly(docs, target, longest, percent)
    assert importance.resample(none, goal).count() == 0
    unknown = importance.resample(odd, none).collect()
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in unknown), key=str) == plainly(docs, [])


def test_query(spark, sf):
    from examloom.llm.queries import op12_importance

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = op12_importance(spark, sf)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted([tuple(r) for r in got.collect()], key=str) == plainly(docs, target)


def test_ranks_of_one_key(spark):
    """One key of most rows: every rank once, over many partitions."""
    r = random.Random(3)
    rows = [(7 if r.random() < 0.8 else r.randrange(20), i) for i in range(3000)]
    got, n = ranked(spark.createDataFrame(rows, "k long, v long").repartition(6), [__import__("pyspark").sql.functions.col("k").desc()])
    out = sorted((x["rank"], x["k"]) for x in got.collect())
    assert n == 3000 and [x for x, _ in out] == list(range(1, 3001)) and [k for _, k in out] == sorted((k for k, _ in rows), reverse=True)
