"""Lookups of the record store, and text and geometry rules that no query reads: nulls, ties, repeats and empty tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from examloom.functions import text as tx
from examloom.keyed_log import KeyedLog
from examloom.operators import edits, geometry, narrowing, store

DAY = datetime(2024, 1, 1)
SCHEMA = "run_id long, kind string, page_index int, created_at timestamp, seq long, path string"


def artifacts(spark):
    rows = [(1, "crop", 0, DAY, 2, "images/a.jpg"), (1, "crop", 0, DAY, 1, "images/b.jpg"), (1, "crop", 1, DAY, 3, "images/a.jpg"), (1, "page-text", 0, DAY, 4, None), (2, "crop", 0, DAY - timedelta(days=1), 5, "images/a.jpg"), (2, "crop", None, DAY, 6, "x")]
    return spark.createDataFrame(rows, SCHEMA)


def test_lookups(spark):
    a = artifacts(spark)
    assert [r["seq"] for r in store.scan(a, 1, "crop").collect()] == [1, 2, 3]
    assert [r["seq"] for r in store.at_index(a, 1, "crop", 0).collect()] == [1]  # equal times: the least seq
    assert store.at_index(a, 9, "crop", 0).count() == store.at_index(a.limit(0), 1, "crop", 0).count() == 0
    wanted = spark.createDataFrame([(1, "images/a.jpg"), (1, "images/a.jpg"), (2, "none"), (1, None)], "run_id long, path string")
    assert sorted(r["seq"] for r in store.at_path(a, "crop", wanted).collect()) == [2, 3]


def test_kinds_are_folders(spark, tmp_path):
    """A scan of one kind reads that kind's folder only; a second write adds to it."""
    for _ in range(2):
        store.write_artifacts(artifacts(spark), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s")).filter("kind = 'crop'")
    assert back.count() == 10 and all("kind=crop" in r["f"] for r in back.select(F.input_file_name().alias("f")).distinct().collect())


def test_artifacts_in_a_shared_log(spark, tmp_path):
    """Appended rows get their version and place; two kinds of one run stand apart."""
    log = KeyedLog(spark, str(tmp_path), SCHEMA, ["run_id", "kind", "seq"])
    log.append(artifacts(spark))
    log.append(artifacts(spark).filter("seq = 4").withColumn("path", F.lit("new")))
    assert log.current().count() == 6 and log.current().filter("seq = 4").first()["path"] == "new"
    assert {r["_version"] for r in log.entries().collect()} == {1, 2}


def test_clearing_and_survivors(spark):
    a = artifacts(spark).withColumn("chunk", F.col("page_index"))
    cleared = spark.createDataFrame([(1, "crop", 0), (2, "crop", None), (2, "crop", None)], "run_id long, kind string, chunk int")
    assert sorted(r["seq"] for r in store.without_artifacts(a, cleared).collect()) == [3, 4]
    assert store.without_artifacts(a, cleared.limit(0)).count() == 6
    assert sorted(r["seq"] for r in store.in_scope(a).collect()) == [1, 2, 3, 5, 6] and store.in_scope(a, everything=True).count() == 6


def test_whole_records(spark):
    rows = spark.createDataFrame([("a", 1), ("", 1), (None, 1), ("b", None)], "id string, job_id int")
    assert [r["id"] for r in store.whole_records(rows, "job_id").collect()] == ["a"] and {r["id"] for r in store.whole_records(rows).collect()} == {"a", "b"}


def test_jumps(spark):
    rows = spark.createDataFrame([("r", 3), ("r", 1), ("r", 7), ("r", 7), ("s", 2), ("t", None)], "run_id string, question_number int")
    assert {r["run_id"]: r["index"] for r in edits.jump_index(rows, 7).collect()} == {"r": 2, "s": -1, "t": -1}


def test_small_rules(spark):
    one = spark.range(1)
    assert one.select(narrowing.was_truncated(F.lit("MAX_TOKENS")), narrowing.was_truncated(F.lit("STOP"))).first()[:] == (True, False)
    assert one.select(geometry.dpi_scale(F.lit(144.0))).first()[0] == 2.0
    drafts = spark.createDataFrame([(["  Heart", "", "Lung ", "\t"],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in drafts.select(tx.cleaned_topics(F.col("t"))).collect()] == [["Heart", "Lung"], [], None]
    assert one.select(tx.short_number(F.lit(1250)), tx.short_number(F.lit(12))).first()[:] == ("1.3k", "12")


def test_exams_without_a_pin_do_not_meet_in_one_task(spark):
    exams = spark.createDataFrame([(1, None), (2, None), (3, 30), (4, 99), (5, None)], "file_id long, pinned long")
    keys = spark.createDataFrame([(30, 2, "answer-key", 5), (20, 2, "answer-key", 5), (40, 4, "answer-key", 1), (50, 5, "exam", 1)], "file_id long, parent_id long, kind string, added_at int")
    found = store.answer_keys(exams, keys)
    assert sorted(map(tuple, found.collect()), key=lambda r: r[0]) == [(1, None), (2, 20), (3, 30), (4, 40), (5, None)]
    assert "isnotnull(pinned" in found._jdf.queryExecution().optimizedPlan().toString()
