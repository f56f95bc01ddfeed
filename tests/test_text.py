from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from examloom.functions import text as tx
from examloom.operators import answers, review


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "bare"),
    [("12. What is it?", "What is it?"), ("Q3) Why", "Why"), ("question 7 - How", "How"), ("18 patients came", "18 patients came"), ("2022. In this trial", "2022. In this trial"), ("5. ", "5. "), ("", "")],
)
def test_question_label(spark, text, bare):
    assert one(spark, tx.strip_question_label(F.col("t")), t=text) == bare


@pytest.mark.parametrize(
    ("options", "bare", "ambiguous"),
    [
        (["A. one x", "B. two"], ["one x", "two"], False),
        (["(a) one", "(b) two"], ["one", "two"], False),
        (["1. one", "2. two"], ["one", "two"], False),
        (["i. one", "ii. two", "iii. three"], ["one", "two", "three"], False),
        (["A. baumannii", "B. fragilis"], ["A. baumannii", "B. fragilis"], True),
        (["A. one", "C. two"], ["A. one", "C. two"], False),
        (["A. one"], ["A. one"], False),
        ([], [], False),
        (["A. one", "two"], ["A. one", "two"], False),
    ],
)
def test_enumeration(spark, options, bare, ambiguous):
    got = one(spark, tx.strip_enumeration(F.col("o")), o=options)
    assert (got["options"], got["ambiguous"]) == (bare, ambiguous)


def test_table(spark):
    q = "Look:\n| a | b |\n|---|---|\n| 1 | 2 |\n\nWhich?"
    assert one(spark, tx.strip_table(F.col("q")), q=q) == "Look:\n\nWhich?"
    for same in ("no table | here", "| a |\n|---|\n| 1 |", ""):
        assert one(spark, tx.strip_table(F.col("q")), q=same) == same


@pytest.mark.parametrize(("name", "safe"), [("Exam: 1/2.PDF", "Exam- 1-2"), ("..  .pdf", "exam"), ("a\tb.pdf", "ab"), ("x  y.pdf", "x y")])
def test_bundle_name(spark, name, safe):
    assert one(spark, tx.safe_bundle_name(F.col("n")), n=name) == safe


def test_small_rules(spark):
    assert one(spark, tx.csv_field(F.col("t")), t='a "b", c') == '"a ""b"", c"'
    assert one(spark, tx.csv_field(F.col("t")), t="plain") == "plain"
    assert one(spark, tx.parent_row(F.col("t")), t="12~m3") == "12"
    assert one(spark, tx.parent_row(F.col("t")), t="a~m1~m2") == "a~m1"
    assert one(spark, tx.is_newer(F.col("a"), F.col("b")), a="1.10", b="1.9.9") is True
    assert one(spark, tx.is_newer(F.col("a"), F.col("b")), a="1.2.0", b="1.2") is False
    assert one(spark, tx.assemble_question(F.col("s"), F.col("p"), F.col("t")), s="1. A man", p="2) Why?", t="{case_stem}\n{question_prompt}") == "A man\nWhy?"
    assert one(spark, tx.assemble_question(F.col("s"), F.col("p"), F.col("t")), s="", p="Why?", t="{case_stem} {question_prompt}") == "Why?"
    assert one(spark, tx.similarity(tx.tokens(F.col("a")), tx.tokens(F.col("b"))), a="the red house", b="the red garden gate") == 0.5
    assert one(spark, tx.similarity(tx.tokens(F.col("a")), tx.tokens(F.col("b"))), a="", b="red") == 0
    assert one(spark, tx.jpeg_path(F.col("a")), a="images/a.png") == "images/a.jpg"
    assert one(spark, tx.bundle_path(F.col("a")), a=".\\x\\y") == "x/y"


@pytest.mark.parametrize(
    ("policy", "reason", "answer", "want"),
    [
        ("no_answer_key", "", "1", ("", "no_answer_key")), ("mixed", "conflicting_marks", "1", ("", "conflicting_marks")), ("mixed", "", " ", ("", "no_visible_answer")),
        ("mixed", "", "b", ("", "key_unclear")), ("mixed", "", "2", ("", "index_out_of_range")), ("mixed", "", "01", ("1", "")), ("mixed", "", "99999999999", ("", "index_out_of_range")),
    ],
)
def test_forced_answer(spark, policy, reason, answer, want):
    got = one(spark, answers.forced_answer(F.col("p"), F.col("r"), F.col("a"), F.col("o")), p=policy, r=reason, a=answer, o=["x", "y"])
    assert tuple(got) == want


@pytest.mark.parametrize(
    ("reason", "answer", "want"),
    [("not_mcq", "", "not-mcq"), ("multiple_mark", "", "conflicting-marks"), ("options_cut", "", "length-mismatch"), ("key_unclear", "", "low-confidence"), ("odd", "1", "low-confidence"), ("no_answer_key", "", "blank-answer")],
)
def test_flag_category(spark, reason, answer, want):
    assert one(spark, review.flag_category(F.col("r"), F.col("a")), r=reason, a=answer) == want


def test_short_numbers(spark):
    """Halves fall as the nearest double does: 1.25 is exact and goes up, 1.15 lies below and 1.45 too, 8.35 above."""
    from decimal import ROUND_HALF_UP, Decimal

    ns = [0, 999, 1000, 1049, 1050, 1051, 1150, 1250, 1350, 1450, 8350, 9950, 9999, 123450, 2048050, 2048150, 99_999_950, 2_100_000_050, 3_000_000_150, *range(1050, 60_000, 100)]
    want = {n: str(n) if n < 1000 else f"{Decimal(n / 1000).quantize(Decimal('0.1'), ROUND_HALF_UP)}k" for n in ns}
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    assert {r["n"]: r["s"] for r in df.select("n", tx.short_number(F.col("n")).alias("s")).collect()} == want
