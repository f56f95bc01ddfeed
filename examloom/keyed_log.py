"""An append-only table of keyed entries that several writers can share (S11, M1-M7, ST2, S17).

Entries lie in folders of Parquet files; a version is a small file that names the folders it adds and takes away. A version's file appears at once or not at
all, and only one writer can make it: who comes second takes the next number. So what is half written is never read, no writer's entries
are lost, and readers see one version throughout. The driver handles one name for each write, never entries.
"""

from __future__ import annotations

import json
import os
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(Exception):
    """Somebody else wrote what this write was based on."""


class KeyedLog:
    """``schema`` are the columns of an entry, ``keys`` those that name it. Entries also have ``deleted``, and when read ``_version`` and ``_place``, their order."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.columns = [f.name for f in self.schema]
        self.stored = T.StructType([*self.schema, T.StructField("deleted", T.BooleanType()), T.StructField("_version", T.LongType()), T.StructField("_place", T.LongType())])

    # Files

    def _fs(self, path: str) -> tuple[Any, Any]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _commit_file(self, version: int) -> str:
        return f"{self.path}/_log/{version:020d}.json"

    def _put_if_absent(self, version: int, text: str) -> bool:
        """Whether the version's file could be made; it appears with all its text."""
        jvm, draft = self.spark._jvm, f"{self.path}/_log/.{uuid.uuid4().hex}"
        fs, place = self._fs(draft)
        out = fs.create(place, True)
        out.write(bytearray(text.encode()))
        out.close()
        _, final = self._fs(self._commit_file(version))
        try:
            if fs.getScheme() == "file":  # a local rename would replace the other writer's file; a link never does
                os.link(place.toUri().getPath(), final.toUri().getPath())
            else:
                plain = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                options = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = plain
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration()).rename(place, final, options)
            return True
        except FileExistsError:
            return False
        except Exception:
            if fs.exists(final):
                return False
            raise
        finally:
            if fs.exists(place):
                fs.delete(place, False)

    def commits(self) -> list[tuple[int, dict]]:
        """(version, what it adds and takes away), in order."""
        fs, place = self._fs(f"{self.path}/_log")
        if not fs.exists(place):
            return []
        found = sorted(s.getPath().getName() for s in fs.listStatus(place) if s.getPath().getName().endswith(".json") and not s.getPath().getName().startswith("."))
        out = []
        for name in found:
            reader = fs.open(self._fs(f"{self.path}/_log/{name}")[1])
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(reader, "UTF-8")
            reader.close()
            out.append((int(name.removesuffix(".json")), json.loads(text)))
        return out

    def version(self) -> int:
        """The newest version; 0 before the first write."""
        return max((v for v, _ in self.commits()), default=0)

    def _live(self, upto: int | None = None, since: int = 0) -> dict[str, int]:
        """Folders and the versions that added them."""
        live: dict[str, int] = {}
        for v, c in self.commits():
            if upto is None or v <= upto:
                live = {f: at for f, at in live.items() if f not in c["remove"]} | (dict.fromkeys(c["add"], v) if v > since else {})
        return live

    # Reading

    def entries(self, version: int | None = None, since: int = 0) -> DataFrame:
        """All entries up to a version, from those after ``since``."""
        folders = self._live(version, since)
        if not folders:
            return self.spark.createDataFrame([], self.stored)
        # A folder's entries have its version; compacted ones say their own. There are as many folders as writes since the last compaction.
        added = F.broadcast(self.spark.createDataFrame([(f.rpartition("/")[2], v) for f, v in folders.items()], "_folder string, _added long"))
        rows = self.spark.read.schema(self.stored).parquet(*(f"{self.path}/{f}" for f in folders)).withColumn("_folder", F.regexp_extract("_metadata.file_path", "/data/([0-9a-f]+)/", 1))
        return rows.join(added, "_folder").withColumn("_version", F.coalesce("_version", "_added")).filter(F.col("_version") > since).select(*self.stored.fieldNames())

    def _newest(self, entries: DataFrame) -> DataFrame:
        rest = [c for c in self.stored.fieldNames() if c not in self.keys]
        last = entries.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct("_version", "_place")).alias("_last"))
        return last.select(*self.keys, "_last.*").select(*self.stored.fieldNames())

    def current(self, version: int | None = None) -> DataFrame:
        """The last entry of each key, without deleted ones."""
        return self._newest(self.entries(version)).filter(~F.col("deleted")).select(*self.columns)

    # Writing

    def _write(self, rows: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def append(self, rows: DataFrame, based_on: int | None = None) -> int:
        """Adds entries and returns their version. With ``based_on``, it is a conflict if a key of ``rows`` was written after that version. A column ``deleted`` marks keys that go.

        Within one write, of several entries of a key the last one read counts. Without ``based_on`` a write always succeeds.
        """
        based_on_given, seen = based_on is not None, self.version() if based_on is None else based_on
        gone = F.coalesce("deleted", F.lit(False)) if "deleted" in rows.columns else F.lit(False)
        folder = self._write(rows.select(*self.columns, gone.alias("deleted"), F.lit(None).cast("long").alias("_version"), F.monotonically_increasing_id().alias("_place")))
        while True:
            at = self.version()
            if based_on_given and at > seen:
                mine = self.spark.read.schema(self.stored).parquet(f"{self.path}/{folder}").select(*self.keys)
                if not self.entries(at, since=seen).join(mine, self.keys, "left_semi").isEmpty():
                    raise Conflict(f"keys were written after version {seen}")
                seen = at
            if self._put_if_absent(at + 1, json.dumps({"add": [folder], "remove": []})):
                return at + 1

    def compact(self) -> int:
        """One folder with the last entry of each key in place of all others. Writes that come meanwhile stay; two compactions of the same folders are a conflict."""
        at = self.version()
        old = list(self._live(at))
        kept = self._newest(self.entries(at)).filter(~F.col("deleted"))
        folder = self._write(kept)
        while True:
            if set(old) - set(self._live(self.version())):
                raise Conflict("these entries were compacted already")
            at = self.version()
            if self._put_if_absent(at + 1, json.dumps({"add": [folder], "remove": old})):
                return at + 1

    def vacuum(self) -> int:
        """Deletes folders that no version names any more, or ever did; call it when nobody reads or writes. Returns their number."""
        live = set(self._live())
        fs, place = self._fs(f"{self.path}/data")
        dead = [s.getPath() for s in fs.listStatus(place) if f"data/{s.getPath().getName()}" not in live] if fs.exists(place) else []
        for p in dead:
            fs.delete(p, True)
        return len(dead)
