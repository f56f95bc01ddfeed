"""Streams against the batch operators: reordered and late events, and a restart from a checkpoint in between."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from examloom.operators import telemetry
from examloom.streaming import ordered

SCHEMA = "run_id long, t timestamp, seq long, event string"
START = datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def events(seed: int) -> list[tuple]:
    """Shuffled within ten minutes; times with microseconds, and some equal ones."""
    r, out = random.Random(seed), []
    for i in range(240):
        at = START + timedelta(seconds=30 * i, microseconds=r.choice([0, 0, 1, 999_999]))
        out += [(r.randrange(3), at, 2 * i + k, r.choice(["error", "error", "click"])) for k in range(r.choice([1, 1, 2]))]
    return sorted(out, key=lambda e: e[1] + timedelta(seconds=r.uniform(0, 500)))


def run(spark, tmp_path, build, batches: list[list[tuple]], restart_at: int) -> list:
    """All that the stream of files has told, with the query stopped and started again from its checkpoint after some files."""
    source = str(tmp_path / "in")
    out: list = []

    def write(lo: int, hi: int) -> None:
        for i in range(lo, hi):
            spark.createDataFrame(batches[i], SCHEMA).coalesce(1).write.mode("append").json(f"{source}/{i:03d}", timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS")

    def go() -> None:
        log = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(source)
        q = build(log).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
        q.stop()

    write(0, restart_at)
    go()
    write(restart_at, len(batches))
    go()
    return out


def pieces(rows: list[tuple], n: int = 4) -> list[list[tuple]]:
    size = -(-len(rows) // n)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def test_sliding_window(spark, tmp_path):
    rows = events(1)
    # A last event of each run, far away, lets the watermark pass all others.
    ends = [(k, START + timedelta(days=9), 10_000 + k, "end") for k in range(3)]
    got = run(spark, tmp_path, lambda log: ordered.rate_window(log, 120), [*pieces(rows), ends, [(0, START + timedelta(days=20), 20_000, "end")]], 3)
    want = telemetry.rate_window(spark.createDataFrame(rows, SCHEMA), 120, "run_id").collect()
    key = lambda r: (r["run_id"], r["seq"], r["recent"], r["gap_s"])
    assert sorted(map(key, (r for r in got if r["seq"] < 10_000)), key=str) == sorted(map(key, want), key=str)


def test_streaks_and_late_events(spark, tmp_path):
    rows = events(2)
    parts = pieces(rows)
    # Days behind the watermark: dropped.
    late = [(0, START - timedelta(days=3), 77_777, "error")]
    ends = [(k, START + timedelta(days=9), 10_000 + k, "end") for k in range(3)]
    got = run(spark, tmp_path, ordered.failure_streaks, [*parts, late, ends, [(0, START + timedelta(days=20), 20_000, "end")]], 2)
    want = telemetry.failure_streaks(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: (r["run_id"], r["seq"], r["streak"], r["demoted"])
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_newest(spark, tmp_path):
    rows = events(3)
    got = run(spark, tmp_path, lambda log: ordered.newest(log, 10), pieces(rows), 2)
    table: set = set()
    for r in got:
        (table.add if r["change"] == "kept" else table.discard)((r["run_id"], r["seq"]))
    want = telemetry.newest(spark.createDataFrame(rows, SCHEMA), 10, "run_id").select("run_id", "seq").collect()
    assert table == {tuple(r) for r in want}


def test_new_events_do_not_read_or_rewrite_what_is_held():
    """Held events and timers of one key, told by the calls that reach the state store."""
    import pandas as pd

    class Held:
        def __init__(self):
            self.rows, self.calls = [], []

        def __getattr__(self, name):
            def call(*args):
                self.calls.append(name)
                if name == "get":
                    return iter(list(self.rows))
                self.rows = [] if name == "clear" else [*(self.rows if name == "appendList" else []), *args[0]]

            return call

    class Handle:
        timers: list = []
        held = Held()
        getListState = lambda self, *_: self.held
        listTimers = lambda self: iter([(t,) for t in self.timers])
        registerTimer = lambda self, t: self.timers.append(t)
        deleteTimer = lambda self, t: self.timers.remove(t)

    handle, stream = Handle(), ordered.InOrder()
    stream.init(handle)
    for micros, timer in ((5_000, 5), (9_000, 5), (3_001, 4), (4_000, 4)):
        stream.handleInputRows((1,), iter([pd.DataFrame({"micros": [micros], "seq": [micros], "event": ["error"]})]), None)
        assert handle.timers == [timer]
    assert handle.held.calls == ["appendList"] * 4 and len(handle.held.rows) == 4
