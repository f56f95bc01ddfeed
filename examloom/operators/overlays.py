"""Writers of decisions over exam rows (M2-M7, S11): entries of one keyed log, whose current state is what review works on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examloom.keyed_log import Conflict, KeyedLog

SCHEMA = "run_id string, kind string, row_id string, value string, fields map<string,string>"
KEYS = ["run_id", "kind", "row_id"]
RESOLUTION, EDIT, DELETION, ADDITION, ANSWER, MATCH = "resolution", "edit", "deletion", "addition", "answer", "match"
#: How often a write that is based on what it read is tried again.
TRIES = 20


class Overlays:
    """Decisions of a store, by run, kind and row. Writers may work at the same time, also on the same rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.log = KeyedLog(spark, path, SCHEMA, KEYS)

    def current(self, kind: str) -> DataFrame:
        """run_id, row_id, value and fields of a kind, as they are now."""
        return self.log.current().filter(F.col("kind") == kind).drop("kind")

    @staticmethod
    def _entries(rows: DataFrame, kind: str, value: str | None = None, fields: str | None = None, deleted: bool = False) -> DataFrame:
        return rows.select(
            "run_id", F.lit(kind).alias("kind"), F.col("row_id"), (F.col(value).cast("string") if value else F.lit(None).cast("string")).alias("value"),
            (F.col(fields) if fields else F.lit(None).cast("map<string,string>")).alias("fields"), F.lit(deleted).alias("deleted"),
        )

    def _again(self, write: Callable[[int], int]) -> int:
        for _ in range(TRIES):
            try:
                return write(self.log.version())
            except Conflict:
                continue
        raise Conflict(f"others wrote the same rows {TRIES} times")

    def resolve(self, picks: DataFrame) -> int:
        """M2: run_id, row_id, pick."""
        return self.log.append(self._entries(picks, RESOLUTION, "pick"))

    def clear(self, kind: str, rows: DataFrame) -> int:
        """M2, M7: takes a kind's entries of rows (run_id, row_id) back."""
        return self.log.append(self._entries(rows, kind, deleted=True))

    def clear_runs(self, kind: str, runs: DataFrame) -> int:
        """M2, M7: takes all of a kind's entries of runs (run_id) back, as they are at this moment."""
        return self._again(lambda at: self.log.append(self._entries(self.log.current(at).filter(F.col("kind") == kind).join(runs.select("run_id").distinct(), "run_id", "left_semi"), kind, deleted=True), at))

    def edit(self, patches: DataFrame) -> int:
        """M3: run_id, row_id, fields: a map over what was edited before; a blank value takes its field's edit back, and rows without edits lose their entry.

        What it is based on is read again if another writer changed one of the rows meanwhile, so that two edits of different fields both hold.
        """
        one = patches.groupBy("run_id", "row_id").agg(F.last("fields").alias("patch"))

        def write(at: int) -> int:
            before = self.log.current(at).filter(F.col("kind") == EDIT).select("run_id", "row_id", F.col("fields").alias("old"))
            both = one.join(before, ["run_id", "row_id"], "left")
            old = F.map_filter(F.coalesce("old", F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key("patch", k))
            fields = F.map_concat(old, F.map_filter("patch", lambda _, v: F.trim(F.coalesce(v, F.lit(""))) != ""))
            rows = both.select("run_id", "row_id", fields.alias("fields"))
            return self.log.append(self._entries(rows, EDIT, fields="fields").withColumn("deleted", F.size("fields") == 0), at)

        return self._again(write)

    def delete_rows(self, rows: DataFrame) -> int:
        """M4: marks rows as deleted; ``clear(DELETION, rows)`` undoes it."""
        return self.log.append(self._entries(rows, DELETION))

    def add_rows(self, rows: DataFrame) -> int:
        """M5: adds blank rows (run_id, row_id)."""
        return self.log.append(self._entries(rows, ADDITION))

    def answer(self, answers: DataFrame) -> int:
        """M7: run_id, row_id, answer: an index into the options."""
        return self.log.append(self._entries(answers, ANSWER, "answer"))

    def match(self, matches: DataFrame) -> int:
        """M7: run_id, row_id, fields (topic, subtopic)."""
        return self.log.append(self._entries(matches, MATCH, fields="fields"))

    def remap(self, options: DataFrame) -> int:
        """M6: run_id, row_id, before, after: answers and resolutions follow their option's text to where it stands now, and go where it is gone."""
        moved = options.select("run_id", "row_id", "before", "after")

        def write(at: int) -> int:
            held = self.log.current(at).filter(F.col("kind").isin(ANSWER, RESOLUTION)).join(moved, ["run_id", "row_id"])
            place = F.array_position("after", F.get("before", F.col("value").try_cast("int"))) - 1
            rows = held.select("run_id", "kind", "row_id", F.when(place >= 0, place.cast("string")).alias("value"), "fields")
            return self.log.append(rows.withColumn("deleted", F.col("value").isNull()), at)

        return self._again(write)
