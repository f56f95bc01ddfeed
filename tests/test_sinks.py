"""Shared logs, decisions, resumed stages, bundles and snapshots: writers at the same time, and failures half-way."""

from __future__ import annotations

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from examloom.keyed_log import Conflict, KeyedLog
from examloom.operators.overlays import ANSWER, DELETION, EDIT, MATCH, RESOLUTION, Overlays
from examloom.operators.resume import Stage, run_stages
from examloom.sources import bundles


def log_at(spark, path) -> KeyedLog:
    return KeyedLog(spark, str(path), "k long, v string", ["k"])


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k long, v string")


def content(log: KeyedLog, version=None) -> dict:
    return {r["k"]: r["v"] for r in log.current(version).collect()}


def test_last_entry_counts(spark, tmp_path):
    log = log_at(spark, tmp_path)
    assert log.version() == 0 and content(log) == {}
    log.append(rows(spark, (1, "a"), (2, "b")))
    log.append(rows(spark, (1, "c"), (3, None)))
    log.append(rows(spark, (2, "x")).withColumn("deleted", F.lit(True)))
    assert content(log) == {1: "c", 3: None} and content(log, 1) == {1: "a", 2: "b"}
    log.append(rows(spark, (2, "back")))
    assert log.compact() == 5 and content(log) == {1: "c", 2: "back", 3: None}
    assert log.vacuum() == 4 and content(log) == {1: "c", 2: "back", 3: None}
    log.append(rows(spark, (1, "after")))
    assert content(log)[1] == "after"
    log.append(rows(spark).limit(0))
    assert len(content(log)) == 3


def test_writers_at_the_same_time(spark, tmp_path):
    """Every writer's entries are there, each under a version of its own."""
    versions, errors = [], []

    def write(n: int) -> None:
        try:
            log = log_at(spark, tmp_path)
            for i in range(3):
                versions.append(log.append(rows(spark, (n * 10 + i, f"{n}/{i}"), (999, f"{n}/{i}"))))
        except BaseException as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    found = content(log_at(spark, tmp_path))
    assert not errors and sorted(versions) == list(range(1, 13))
    assert {k: v for k, v in found.items() if k < 999} == {n * 10 + i: f"{n}/{i}" for n in range(4) for i in range(3)} and 999 in found


def test_conflicts(spark, tmp_path):
    log = log_at(spark, tmp_path)
    at = log.append(rows(spark, (1, "a"), (2, "b")))
    log.append(rows(spark, (1, "other")))
    with pytest.raises(Conflict):
        log.append(rows(spark, (1, "mine")), based_on=at)
    log.append(rows(spark, (2, "mine")), based_on=at)
    log.compact()
    log.append(rows(spark, (3, "new")), based_on=at)  # a compaction is no write
    assert content(log) == {1: "other", 2: "mine", 3: "new"}
    stale = log_at(spark, tmp_path)
    real, done = stale._write, []

    def slow(df):
        if not done:
            done.append(log.compact())
        return real(df)

    stale._write = slow
    with pytest.raises(Conflict):
        stale.compact()


def test_half_written_is_never_read(spark, tmp_path, monkeypatch):
    log = log_at(spark, tmp_path)
    log.append(rows(spark, (1, "a")))
    monkeypatch.setattr(log, "_put_if_absent", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        log.append(rows(spark, (2, "b")))
    assert content(log_at(spark, tmp_path)) == {1: "a"} and log_at(spark, tmp_path).vacuum() == 1


def test_overlays(spark, tmp_path):
    o = Overlays(spark, str(tmp_path))
    make = lambda data, schema: spark.createDataFrame(data, schema)
    row = "run_id string, row_id string"
    o.resolve(make([("r", "1", 2), ("r", "2", 0)], f"{row}, pick int"))
    o.clear(RESOLUTION, make([("r", "2")], row))
    o.edit(make([("r", "1", {"question": "Q", "topic": "T"})], f"{row}, fields map<string,string>"))
    o.edit(make([("r", "1", {"topic": " ", "year": "2024"}), ("r", "3", {"year": ""})], f"{row}, fields map<string,string>"))
    o.delete_rows(make([("r", "4"), ("r", "5")], row))
    o.clear(DELETION, make([("r", "5")], row))
    o.answer(make([("r", "6", 1), ("r", "7", 0), ("s", "6", 1)], f"{row}, answer int"))
    o.remap(make([("r", "6", ["a", "b", "c"], ["b", "a"]), ("r", "7", ["a"], ["x"]), ("r", "1", ["a", "b", "c"], ["c"])], f"{row}, before array<string>, after array<string>"))
    o.match(make([("r", "1", {"topic": "Heart"}), ("s", "1", {"topic": "Lung"})], f"{row}, fields map<string,string>"))
    o.clear_runs(MATCH, make([("r",)], "run_id string"))
    state = lambda kind, c: {(r["run_id"], r["row_id"]): r[c] for r in o.current(kind).collect()}
    assert state(RESOLUTION, "value") == {("r", "1"): "0"}
    assert state(EDIT, "fields") == {("r", "1"): {"question": "Q", "year": "2024"}}
    assert state(DELETION, "value") == {("r", "4"): None}
    assert state(ANSWER, "value") == {("r", "6"): "0", ("s", "6"): "1"}
    assert state(MATCH, "fields") == {("s", "1"): {"topic": "Lung"}}


def test_edits_of_one_row_at_the_same_time(spark, tmp_path):
    errors = []

    def write(n: int) -> None:
        try:
            Overlays(spark, str(tmp_path)).edit(spark.createDataFrame([("r", "1", {f"f{n}": "x"})], "run_id string, row_id string, fields map<string,string>"))
        except BaseException as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(180)
    assert not errors and Overlays(spark, str(tmp_path)).current(EDIT).first()["fields"] == {f"f{n}": "x" for n in range(4)}


def test_resume(spark, tmp_path):
    """A run that dies between and within stages goes on where it stopped; finished items are never worked on again."""
    tried: list = []
    broken = {"on": True}

    def crops(items):
        tried.append(("crops", sorted(r["id"] for r in items.collect())))
        return items.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("part"))

    def answers(items):
        tried.append(("answers", sorted({r["id"] for r in items.collect()})))
        out = items.select("id", "part", (F.col("id") * 10 + F.col("part")).alias("answer"))
        return out.withColumn("answer", F.when((F.col("id") == 2) & F.lit(broken["on"]), F.raise_error(F.lit("killed"))).otherwise(F.col("answer")))

    def stages():
        return [Stage(spark, str(tmp_path), "crops", crops, "id long, part int", ["id"], ["id", "part"]), Stage(spark, str(tmp_path), "answers", answers, "id long, part int, answer long", ["id"], ["id", "part"])]

    items = spark.range(1, 4)
    with pytest.raises(Exception, match="killed"):
        run_stages(stages(), items).collect()
    assert [x[0] for x in tried] == ["crops", "answers"]
    broken["on"] = False
    got = sorted(tuple(r) for r in run_stages(stages(), items).select("id", "part", "answer").collect())
    assert got == [(i, p, i * 10 + p) for i in (1, 2, 3) for p in (0, 1)]
    assert [x[0] for x in tried] == ["crops", "answers", "answers"]
    more = run_stages(stages(), spark.range(1, 6)).count()
    assert more == 10 and tried[3:] == [("crops", [4, 5]), ("answers", [4, 5])]
    stages()[1].redo(spark.range(2, 3))
    run_stages(stages(), spark.range(1, 6)).count()
    assert tried[5:] == [("answers", [2])]


def exports(spark):
    lines = spark.createDataFrame([("B", 2, "b2"), ("A", 1, 'a1,"x"'), ("B", 1, "b1"), ("Ünï (v2)", 1, "é")] + [("long", i, f"l{i}") for i in range(5000)], "name string, pos int, line string").repartition(5)
    pictures = spark.createDataFrame([("A", "images/asset01.jpg", b"\x00\x01"), ("A", "images/asset02.jpg", None), ("none", "images/x.jpg", b"x")], "name string, path string, content binary")
    return lines, pictures


def test_bundles(spark, tmp_path):
    lines, pictures = exports(spark)
    for _ in range(2):  # a second export replaces the first
        bundles.write_bundles(lines, pictures, tmp_path.as_uri(), "h1,h2")
    files = {str(p.relative_to(tmp_path)): p.read_bytes() for p in Path(tmp_path).rglob("*") if p.is_file()}
    assert files.pop("long Cx/long Cx.csv").decode("utf-8-sig") == "h1,h2\r\n" + "".join(f"l{i}\r\n" for i in range(5000))
    bom = b"\xef\xbb\xbf"
    assert files == {
        "A Cx/A Cx.csv": bom + b'h1,h2\r\na1,"x"\r\n', "A Cx/images/asset01.jpg": b"\x00\x01", "A Cx/images/asset02.jpg": b"", "B Cx/B Cx.csv": bom + b"h1,h2\r\nb1\r\nb2\r\n", "Ünï (v2) Cx/Ünï (v2) Cx.csv": bom + "h1,h2\r\né\r\n".encode(),
    }


def test_a_failing_task_leaves_no_bundle(spark, tmp_path):
    lines, pictures = exports(spark)
    broken = lines.withColumn("line", F.when((F.col("name") == "long") & (F.col("pos") == 4000), F.raise_error(F.lit("lost"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="lost"):
        bundles.write_bundles(broken, pictures, tmp_path.as_uri(), "h")
    assert [p for p in Path(tmp_path).rglob("*") if p.is_file()] == []


def test_snapshots(spark, tmp_path):
    tables = {"runs": rows(spark, (1, "a"), (2, "b")), "files": rows(spark).limit(0)}
    path = str(tmp_path / "s")
    bundles.write_snapshot(tables, path, "everything", 5)
    m = bundles.read_manifest(spark, path)
    assert (m["scope"], m["created_at"], m["tables"]) == ("everything", 5, {"runs": 2, "files": 0})
    back = bundles.read_snapshot(spark, path)
    assert sorted(tuple(r) for r in back["runs"].collect()) == [(1, "a"), (2, "b")] and back["files"].count() == 0
    with pytest.raises(FileExistsError):
        bundles.write_snapshot(tables, path)
    bad = {"runs": rows(spark, (1, "a")).withColumn("v", F.raise_error(F.lit("lost")))}
    with pytest.raises(Exception, match="lost"):
        bundles.write_snapshot({**tables, **bad}, str(tmp_path / "t"))
    assert [p.name for p in tmp_path.iterdir()] == ["s"]
    bundles.write_snapshot(tables, str(tmp_path / "new"), version=bundles.VERSION + 1)
    for where, reason in (("new", "newer-version"), ("nothing", "not-a-backup")):
        with pytest.raises(bundles.SnapshotError) as e:
            bundles.read_snapshot(spark, str(tmp_path / where))
        assert e.value.reason == reason
    spark.createDataFrame([("{broken",)], "value string").write.text(str(tmp_path / "odd" / "manifest"))
    with pytest.raises(bundles.SnapshotError):
        bundles.read_manifest(spark, str(tmp_path / "odd"))


def test_snapshot_needs_tables(spark):
    with pytest.raises(StopIteration):
        bundles.write_snapshot({}, "/nowhere")
