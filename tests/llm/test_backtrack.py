"""Operator 13 against the tiktoken library and plain merging."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from examloom.llm import backtrack
from tests.llm.test_tokens import mixtures

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=backtrack.codec(PATH).ranks, special_tokens={})


def test_as_the_library(library):
    r = random.Random(6)
    texts = mixtures(1500) + ["ab" * 3000, " " * 3000, "éa" * 1000, "мир привет " * 50, "नमस्ते", "\x00\x01", "á" * 40]
    texts += ["".join(r.choice("thearnsioл") for _ in range(r.randint(1, 200))) for _ in range(500)]
    codec = backtrack.codec(PATH)
    got = codec.encode(texts)
    assert [g.tolist() for g in got] == [library.encode_ordinary(t) for t in texts]
    assert [codec.decode(g) for g in got] == [t.encode() for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    codec = backtrack.codec(PATH)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    assert codec.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_seams_as_merging():
    codec, r = backtrack.codec(PATH), random.Random(2)
    ids = list(codec.bytes_of)
    short = [i for i in ids if codec.sizes[i] <= 3]
    for _ in range(6000):
        a, b = r.choice(r.choice((ids, short))), r.choice(r.choice((ids, short)))
        raw = [codec.bytes_of[a], codec.bytes_of[b]]
        assert codec.tolerated(a, b) == (backtrack.merged(raw[0] + raw[1], codec.ranks) == raw)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**9))
def test_other_vocabularies(seed):
    """Vocabularies made by merging random pairs over three letters: dead ends are common there. Each word is what plain merging gives."""
    r = random.Random(seed)
    ranks = {bytes([b]): b for b in range(256)}
    letters = [b"a", b"b", b"c"]
    for _ in range(r.randint(1, 25)):
        token = r.choice(letters) + r.choice(letters)
        if token not in ranks and len(token) <= 12 and backtrack.merged(token, ranks) != [token]:
            if len(backtrack.merged(token, ranks)) == 2:
                ranks[token] = len(ranks)
                letters.append(token)
    codec = object.__new__(backtrack.Codec)
    codec.prepare(ranks)
    for _ in range(60):
        word = "".join(r.choice("abc") for _ in range(r.randint(1, 30))).encode()
        assert [codec.bytes_of[i] for i in codec.encode_word(word)] == backtrack.merged(word, ranks)


def test_forgetting(monkeypatch, library):
    monkeypatch.setattr(backtrack, "MOST_PAIRS", 5)
    codec = backtrack.Codec(PATH)
    texts = mixtures(100)
    assert [g.tolist() for g in codec.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_encode_documents(spark, odd, none, library):
    rows = backtrack.encode_documents(odd, PATH).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == library.encode_ordinary(text) and r["decoded"] == text.encode()
    assert backtrack.encode_documents(none, PATH).count() == 0
    ids = spark.createDataFrame([([220, 257, -1, None, 10**6],), (None,), ([],)], "ids array<int>")
    assert [r[0] for r in ids.select(backtrack.decode(F.col("ids"), PATH)).collect()] == [library.decode_bytes([220, 257]), None, b""]


def test_query(spark, sf, library):
    from examloom.llm.queries import op13_byte_bpe

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op13_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
