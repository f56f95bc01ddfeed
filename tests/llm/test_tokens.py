"""Operators 5 and 6 against the tokenizers library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from examloom.llm import bpe, packing, pretokens

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = ["a", "the", "é", "'s", "'t", "'ll", " ", "  ", "\n", "\r\n", "\t", "1", "23", "!", "'", "日本", "🙂", " ", "́", "<|endoftext|>", "don't", "''s", "\x1c", "_", "'S", "word" * 30, "²", "ΑΣ", "İ", "ß", "​"]


def mixtures(n: int) -> list[str]:
    r = random.Random(4)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(n)] + ["", "x" * 5000]


def test_bytes_as_the_library():
    codec, library = bpe.Codec(BYTES), Tokenizer.from_file(BYTES)
    texts = mixtures(1500)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = codec.encode(texts)
    assert [g.tolist() for g in got] == want
    assert [codec.decode(g) for g in got] == library.decode_batch(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    codec = bpe.codec(BYTES)
    assert codec.decode(codec.encode([text])[0]) == text


def test_trees_agree():
    vocab = bpe.codec(BYTES).vocab
    r = random.Random(1)
    for _ in range(300):
        word = "".join(r.choice("thearnsio") for _ in range(r.randint(1, 40)))
        batch, _ = bpe.encode_words([word], vocab)
        assert bpe.merge_one(vocab.byte_ids[np.frombuffer(word.encode(), np.uint8)].tolist(), vocab) == batch.tolist()


def test_words_as_the_library():
    codec, library = packing.WordCodec(WORDS), Tokenizer.from_file(WORDS)
    texts = mixtures(1500)
    assert [g.tolist() for g in codec.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_words_are_one_text():
    """Distinct words go to the library in few texts; where it takes a word apart, each goes alone, and the counts are those of each word."""
    codec, library = packing.WordCodec(WORDS), Tokenizer.from_file(WORDS)
    sent = []

    class Seen:
        def encode_batch_fast(self, texts, **kw):
            sent.extend(texts)
            return library.encode_batch_fast(texts, **kw)

    codec.library = Seen()
    r = random.Random(9)
    words = sorted({"".join(r.choice("etaonriñß") for _ in range(r.randint(1, 12))) for _ in range(6000)}) + ["'s", "!?", "7", "\u0308\u0331", "\u00a8"]
    for some, most in ((words, 2), (["ab1", "x"], 3), ([], 1)):
        sent.clear()
        ids, counts = codec._words(some)
        want = [library.encode(w, add_special_tokens=False).ids for w in some]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
        assert len(sent) <= most


def test_encode_documents(spark, odd, none):
    rows = bpe.encode_documents(odd, BYTES).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert len(by[7]["ids"]) == 0 and by[8]["decoded"] == ""
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert all(by[i]["decoded"] == (texts[i] or "") for i in by)
    assert bpe.encode_documents(none, BYTES).count() == 0


def test_packing(spark, odd, none):
    library = Tokenizer.from_file(WORDS)
    rows = packing.pack_documents(odd, WORDS, F.crc32("ids").alias("crc")).collect()
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    for d in odd.filter("doc_id is not null and doc_id <> 18").collect():
        ids = [*library.encode(d["text"] or "", add_special_tokens=False).ids, packing.END]
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == d["doc_id"]), key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["crc"]) == (at, len(ids), zlib.crc32(part))
            at += r["length"]
        assert at == len(ids)
    assert sum(r["doc_id"] == 18 for r in rows) == 2
    assert packing.pack_documents(none, WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=20))
def test_patterns_hold_everything(histogram):
    packs = packing.patterns(histogram, 64)
    held: dict[int, int] = {}
    for count, lengths in packs:
        assert count > 0 and sum(lengths) <= 64
        for n in lengths:
            held[n] = held.get(n, 0) + count
    assert held == histogram


def test_little_padding():
    r = random.Random(2)
    histogram: dict[int, int] = {}
    for _ in range(20000):
        n = min(4096, int(r.expovariate(1 / 900)) + 1)
        histogram[n] = histogram.get(n, 0) + 1
    packs = packing.patterns(histogram)
    assert sum(n * k for n, k in histogram.items()) / (4096 * sum(c for c, _ in packs)) > 0.99


def test_ranks_in_parts(spark, monkeypatch):
    """Many pieces of one length, in many parts: each sequence is gapless and holds what fits."""
    monkeypatch.setattr(packing, "PART_ROWS", 7)
    rows = [(i, 0, 64 if i % 3 else 1 + i % 40) for i in range(900)] + [(5, 0, 64)] * 3
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, start long, length int").repartition(5), 64).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == sorted((i, n) for i, _, n in rows)
    held: dict = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(held) == list(range(len(held)))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64


def test_equal_hashes_are_told_apart(monkeypatch):
    """Pre-tokens whose hashes agree get their own ids all the same."""
    real = pretokens.span_hashes
    monkeypatch.setattr(pretokens, "span_hashes", lambda *a: real(*a) % np.uint64(11))
    codec, library = packing.WordCodec(WORDS), Tokenizer.from_file(WORDS)
    texts = mixtures(200)
    assert [g.tolist() for g in codec.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("capacity", [1, 7])
def test_no_pieces(capacity):
    assert packing.patterns({}, capacity) == []
