"""Stages whose results are their own checkpoint (ST2): work that is done is never done again, and half-done work never counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examloom.keyed_log import KeyedLog

Work = Callable[[DataFrame], DataFrame]


class Stage:
    """``work`` makes rows of ``schema`` from items; the ``keys`` of an item say which of them are done. An item may give no rows, or several.

    Two logs hold a stage: its rows, and the items it has done. An item counts as done when both were written; what was written without that is
    written again under the same row keys, in place of the old.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, work: Work, schema: str, keys: list[str], row_keys: list[str]):
        self.name, self.work, self.keys = name, work, keys
        self.rows = KeyedLog(spark, f"{root}/{name}/rows", schema, row_keys)
        item = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.rows.schema if f.name in keys)
        self.done = KeyedLog(spark, f"{root}/{name}/done", item, keys)

    def missing(self, items: DataFrame) -> DataFrame:
        """Items that are not done."""
        return items.join(self.done.current().select(*self.keys), self.keys, "left_anti")

    def run(self, items: DataFrame) -> DataFrame:
        """All rows of ``items``: those that were made before, and those made now."""
        todo = self.missing(items)
        if not todo.isEmpty():
            self.rows.append(self.work(todo))
            self.done.append(todo.select(*self.keys).distinct())
        return self.rows.current().join(items.select(*self.keys).distinct(), self.keys, "left_semi")

    def redo(self, items: DataFrame) -> None:
        """Forgets that items (their keys) are done, and their rows."""
        at = self.rows.version()
        old = self.rows.current(at).join(items.select(*self.keys).distinct(), self.keys, "left_semi")
        self.rows.append(old.withColumn("deleted", F.lit(True)), at)
        self.done.append(items.select(*self.keys).distinct().withColumn("deleted", F.lit(True)))


def run_stages(stages: list[Stage], items: DataFrame) -> DataFrame:
    """Each stage's rows are the next one's items. After a failure, the same call goes on where it stopped."""
    for stage in stages:
        items = stage.run(items)
    return items

