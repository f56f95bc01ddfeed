"""Operators 2, 3 and 9: held-out accuracy, defined results for odd rows, and the same scores whatever the partitioning."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from examloom.llm import language, quality, queries, toxicity
from examloom.llm.labelled import sample
from examloom.llm.language import identify_languages
from examloom.llm.quality import classify_quality
from examloom.llm.text_arrays import byte_values, span_hashes
from examloom.llm.toxicity import classify_toxicity

SF01 = "/root/testdata/sf0.01"


def rows(df):
    return sorted(df.collect(), key=str)


@pytest.mark.parametrize(("name", "label", "least"), [("op9_quality_classifier", "quality", 0.8), ("op3_toxicity", "toxic", 0.85)])
def test_held_out(spark, name, label, least):
    got = queries.llm_queries()[name](spark, SF01).join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id").filter("held_out")
    right = got.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]
    assert right >= least


def test_scores_are_the_models_own(spark, sf):
    """Spark's columns against each model applied to one text at a time in plain Python."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    trained = quality.training_labels(labels)
    tox = toxicity.fit(docs, trained)
    pair = tox.compressors()
    want = {}
    for i, t in texts.items():
        z = float(((np.array(toxicity.statistics(t.encode(), *pair)) - tox.mean) / tox.deviation) @ tox.weight + tox.bias)
        want[i] = 1 / (1 + math.exp(-max(-40, min(40, z))))
    assert {r["doc_id"]: r["score"] for r in classify_toxicity(docs, labels).collect()} == pytest.approx(want)
    model = quality.fit(docs, trained)
    mask, golden = (1 << 64) - 1, 0x9E3779B97F4A7C15
    for i, t in list(texts.items())[:40]:
        b, terms = t.encode(), []
        for g in quality.GRAMS:
            for k in range(len(b) - g + 1):
                h = 0
                for v in byte_values(np.frombuffer(b[k : k + g], np.uint8)).tolist():
                    h = (h * 0x100000001B3 + v) & mask
                terms.append(((h * golden) & mask) >> (64 - quality.BITS))
        for w in re.findall(rb"[^\x20\x09-\x0D]+", b):
            one = np.frombuffer(w, np.uint8)
            terms.append(int(span_hashes(byte_values(one), np.array([0]), np.array([len(one)]))[0]) >> (64 - quality.BITS))
        z = float(model.contribution[terms].astype(float).mean() if terms else 0) + model.bias
        want[i] = 1 / (1 + math.exp(-z))
    got = {r["doc_id"]: r["score"] for r in classify_quality(docs, labels).collect()}
    for i in list(texts)[:40]:
        assert got[i] == pytest.approx(want[i], abs=1e-6), i


def test_languages_are_the_models_own(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs)
    got = {r["doc_id"]: r for r in identify_languages(docs).collect()}
    for r in docs.collect()[:60]:
        x = re.sub(rb"[^a-z\x80-\xff]+", b" ", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r["text"] or "").encode()))
        total, n = np.zeros(len(model.weights)), 0
        for g in language.GRAMS:
            for k in range(len(x) - g + 1):
                h = g
                for c in x[k : k + g]:
                    h = h << 8 | c
                total += model.weights[:, ((h * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)) >> (64 - language.BITS)]
                n += 1
        lang, score = language.decide(model, (total / max(1, n) + model.bias)[None, :])
        if re.search(r"[^\W\d_]", r["text"] or ""):
            assert got[r["doc_id"]]["lang_pred"] == lang[0] and got[r["doc_id"]]["score"] == pytest.approx(float(score[0]), abs=1e-5)


def test_samples_are_bounded_and_settled(spark):
    """Repeated ids and texts, any partitioning: the same rows, whatever the length of the texts, within both bounds."""
    rows = [(i, f"text {i} {k} " * (2000 if i % 10 == 0 else 1)) for i in range(60) for k in range(1 + 30 * (i % 7 == 0))]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (None, 1)], "doc_id long, y int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (sorted(map(tuple, sample(d, labels, "y", 20, 100_000).collect())) for d in (docs.repartition(5), docs.orderBy(F.desc("text")).coalesce(2)))
    assert a == b and len({r[0] for r in a}) == len(a)
    for c in (0, 1):
        sizes = [len(r[2]) for r in a if r[1] == c]
        assert 1 < len(sizes) <= 20 and sum(sizes) <= 100_000
    assert any(len(r[2]) > 10_000 for r in a)


def test_languages(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.9
    assert got.filter("score < 0 or score > 1").count() == 0


@pytest.mark.parametrize("classify", [classify_quality, classify_toxicity])
def test_odd_rows(spark, odd, none, labels, classify):
    got = classify(odd, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    scores = got.collect()
    assert len(scores) == odd.count() and all(0 <= r["score"] <= 1 for r in scores)
    by = {r["doc_id"]: r["score"] for r in scores}
    assert by[7] == by[8] and by[1] == by[2]
    assert [r["score"] for r in rows(classify(odd.repartition(7), labels))] == pytest.approx([r["score"] for r in rows(got)])
    assert classify(none, labels).count() == 0
    assert classify(odd, labels.limit(0)).count() == odd.count()


def test_odd_languages(spark, odd, none):
    got = {r["doc_id"]: r for r in identify_languages(odd).collect()}
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0) for i in (7, 8, 9, 20))
    assert got[1]["lang_pred"] == "en"
    assert identify_languages(none).count() == 0
    assert {r["lang_pred"] for r in identify_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_votes_within_the_family():
    model = language.LanguageModel(["de", "en", "fr", "nl"], ["germanic", "romance"], [("de", "en"), ("de", "nl"), ("en", "nl")], np.zeros((5, 1)), np.zeros(5))
    lang, score = language.decide(model, np.array([[1.0, -1, 0.2, -5, 0.1], [-1, 1, 9, 9, 9]]))
    assert list(lang) == ["en", "fr"] or lang[1] == "fr"
    assert ((0 <= score) & (score <= 1)).all()


def test_windows_hold_the_whole_text():
    for text in (b"", b"a", b"x" * 1000, b"word " * 500, "é ".encode() * 333):
        assert b"".join(toxicity.windows(text)) == text


def test_quality_is_learned_in_a_task(spark, monkeypatch):
    """The driver gets the model, not what it was learned from; the model is the one that a loop in the driver gives."""
    docs = spark.createDataFrame([(i, f"{'good plain words' if i % 2 else 'click buy now'} {i}") for i in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    bags = quality.bag(pa.array([r["text"] for r in docs.orderBy("doc_id").collect()]))
    direct = quality.train(bags.to_pylist(), np.arange(40) % 2)
    monkeypatch.setattr(quality, "train", None)
    model = quality.fit(docs, labels)
    assert np.array_equal(model.contribution, direct.contribution) and model.bias == direct.bias
