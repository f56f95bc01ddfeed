from __future__ import annotations

import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n string, block string, carried string, windows string, repeated string, grams string, label string"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))


def cases() -> list[tuple[int | None, str | None]]:
    """Null ids and texts, empty and blank ones, a very long one, copies, near copies, and passages in several texts."""
    base, passage = words(1, 120), words(2, 60)
    near = base.split(" ")
    near[60] = "changed"
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, base.upper()), (5, words(3, 80) + " " + passage + " " + words(4, 50)), (6, passage + words(5, 90)), (7, None), (8, ""), (9, " \n\t "), (10, "one two"),
        (11, "one  two"), (12, words(6, 20000)), (13, words(6, 20000) + " tail"), (14, "é" * 300 + " 日本語 🙂 it's"), (15, "x" * 250), (16, "x" * 120), (17, words(7, 5)), (None, words(8, 30)), (18, words(9, 40)), (18, words(9, 40)), (19, "<|endoftext|> a <|endoftext|>"), (20, "12345 !!! ???"),
    ]


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    """The cases with further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 0, *["?"] * 8) for i, t in cases()], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(1, 20)] + [(3, None, None), (None, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
