"""Exports, folders, tallies and outcomes: nulls, blanks, repeats and empty tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from examloom.operators import narrowing, outcomes, planning


def make(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_exported_columns(spark):
    runs = make(spark, [("a", "ai", None), ("b", "type", "1999"), ("c", "type", None), ("d", "none", None), ("e", None, None)], "run_id string, year_mode string, typed_year string")
    edited = make(spark, [("d", False, True), ("e", True, False)], "run_id string, topics boolean, year boolean")
    flags = outcomes.export_flags(runs, make(spark, [("a",), ("a",)], "run_id string"), edited)
    assert {r["run_id"]: (r["topics"], r["year"], r["stamp"]) for r in flags.collect()} == {"a": (True, True, None), "b": (False, True, "1999"), "c": (False, False, None), "d": (False, True, ""), "e": (True, False, None)}
    rows = make(
        spark, [(r, 1, None, "s", "2020", "f.pdf", 'q "x"', ["a,b"], "0", [], None) for r in "abcde"] + [("d", 2, "t", None, "2020", "f", "q", [], "", ["i"], "1987")],
        "run_id string, pos int, topic string, subtopic string, year string, source string, question string, options array<string>, correct_index string, image_urls array<string>, edited_year string",
    )
    lines: dict = {}
    for r in outcomes.export_lines(rows, flags).orderBy("run_id", "pos").collect():
        lines.setdefault(r["run_id"], []).append(r["line"])
    body = 'f.pdf,"q ""x""","[""a,b""]",0,[]'
    assert lines["a"] == ["topic,subtopic,year,source,question,options,correct_index,image_url", ",s,2020," + body]
    assert lines["b"] == ["year,source,question,options,correct_index,image_url", "1999," + body]
    assert lines["c"] == ["source,question,options,correct_index,image_url", body]
    assert lines["d"] == ["year,source,question,options,correct_index,image_url", "," + body, '1987,f,q,[],,"[""i""]"']
    assert outcomes.export_lines(rows.limit(0), flags).count() == 0


def test_review_list(spark):
    rows = make(spark, [(1, "The Heart", ["x"], True), (2, "lung", ["A HEART"], False), (3, "lung", [], True)], "pos int, question string, options array<string>, open boolean")
    ids = lambda *a: sorted(r["pos"] for r in outcomes.review_list(rows, *a).collect())
    assert ids() == ids("  ") == ids("2") == [1, 2, 3]
    assert ids("heart ") == [1, 2] and ids("heart", F.col("open")) == [1] and ids("7", F.col("open")) == [1, 3] and ids("none") == []


def test_answers_of_manifests(spark):
    texts = ['{"source":"extracted","index":1,"confidence":"certain"}', '{"source":"reasoned","index":1.0,"evidence":3}', '{"source":"reasoned","index":2}', '{"index":0}', "[]", "null", None]
    df = narrowing.read_responses(make(spark, [(i, t) for i, t in enumerate(texts)], "i int, text string"))
    got = [tuple(r["a"]) for r in df.orderBy("i").select(outcomes.narrowed_answer(F.col("value"), F.array(F.lit("a"), F.lit("b"))).alias("a")).collect()]
    none = ("none", None, None, None, False)
    assert got == [("extracted", 1, None, None, False), ("reasoned", 1, "likely", None, False), ("none", None, None, None, True), ("none", 0, None, None, False), none, none, none]


def test_folders(spark):
    made = outcomes.created_folders(make(spark, [(1, " A "), (2, None), (3, "\t")], "job_id int, name string"))
    named = outcomes.renamed_folders(made, make(spark, [(1, "B"), (2, " "), (9, "x")], "job_id int, new_name string"))
    assert {r["job_id"]: r["name"] for r in named.collect()} == {1: "B", 2: outcomes.UNTITLED, 3: outcomes.UNTITLED}
    runs = make(spark, [(1, None), (2, True), (3, False)], "run_id int, excluded boolean")
    flags = make(spark, [(2, False), (3, False), (3, True)], "run_id int, new_excluded boolean")
    assert {r["run_id"]: r["excluded"] for r in outcomes.with_exclusions(runs, flags).collect()} == {1: None, 2: False, 3: True}


def test_outcomes_of_nothing(spark):
    jobs, runs = make(spark, [], "job_id int, kind string"), make(spark, [], "run_id int, job_id int")
    assert tuple(outcomes.restore_outcome(jobs, runs, runs.select("run_id"), runs.select("job_id")).first()) == (0, 0, 0, 0, 0)
    assert tuple(outcomes.backup_contents(jobs, runs, 1).first()) == (0, 0, False)
    own = make(spark, [(5, 1)], "run_id int, job_id int")
    assert tuple(outcomes.backup_contents(jobs, own, 1).first()) == (0, 1, False) and outcomes.backup_contents(jobs, own, 2).first()["backable"]


def test_tallies(spark):
    schema = "key string, day date, model string, requests long"
    day = lambda n: __import__("datetime").date(2024, 1, n)
    stored = make(spark, [("a", day(1), "m", 5), ("b", day(1), "m", 5), ("c", day(2), "m", 7), ("d", day(2), "m", 1)], schema)
    new = make(spark, [("a", day(1), "m", 1), ("a", day(1), "n", 2), ("b", day(2), "m", 3), ("c", day(2), "m", 1)], schema)
    resets = make(spark, [("c", day(2)), ("d", day(3)), ("a", day(1)), ("a", day(1))], "key string, day date").filter("key <> 'a'")
    got = {(r["key"], r["day"].day, r["model"]): r["requests"] for r in outcomes.tallied(stored, new, resets).collect()}
    assert got == {("a", 1, "m"): 6, ("a", 1, "n"): 2, ("b", 2, "m"): 3, ("c", 2, "m"): 1}


def test_all_reasons_are_told(spark):
    rows = make(spark, [(f"reason {i % 1500:04d}",) for i in range(3100)], "needs_review string")
    got = planning.commonest_first(rows, "needs_review").orderBy("place").collect()
    assert len(got) == 1500 and [r["place"] for r in got] == list(range(1, 1501)) and [r["n"] for r in got[:101]] == [3] * 100 + [2] and got[0]["needs_review"] == "reason 0000"
