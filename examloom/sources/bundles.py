"""Export bundles as a data source with a commit in two phases (S14), and snapshots that are whole or absent.

A task writes its bundles into a folder of its attempt; only when all tasks are done are those of the successful attempts renamed to where they belong, and
one that fails takes its folder away. So a failed export leaves nothing that looks like a bundle.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: Fixed value: what a bundle's folder and table are called behind the exam's name.
SUFFIX = " Cx"
BOM, LINE_END = b"\xef\xbb\xbf", b"\r\n"
SCHEMA = "name string, place long, path string, line string, content binary"


@dataclass
class Staged(WriterCommitMessage):
    """The folder of an attempt, and the bundles in it."""

    folder: str
    names: list[str] = field(default_factory=list)


class BundleWriter(DataSourceWriter):
    """Rows come by bundle: its lines in order, and its pictures."""

    def __init__(self, path: str, header: str):
        self.path, self.header, self.job = path.rstrip("/"), header, uuid.uuid4().hex

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    @property
    def staging(self) -> str:
        return f"_staging-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        files, root = self._files()
        out = Staged(f"{self.staging}/{uuid.uuid4().hex}")
        table, name = None, None
        try:
            for r in iterator:
                if r["name"] != name:
                    if table is not None:
                        table.close()
                    name = r["name"]
                    out.names.append(name)
                    folder = f"{root}/{out.folder}/{name}{SUFFIX}"
                    files.create_dir(f"{folder}/images", recursive=True)
                    table = files.open_output_stream(f"{folder}/{name}{SUFFIX}.csv")
                    table.write(BOM + self.header.encode() + LINE_END)
                if r["path"] is None:
                    table.write(r["line"].encode() + LINE_END)
                else:
                    with files.open_output_stream(f"{folder}/{r['path']}") as picture:
                        picture.write(bytes(r["content"] or b""))
        except BaseException:
            if table is not None:
                table.close()
            files.delete_dir(f"{root}/{out.folder}")
            raise
        if table is not None:
            table.close()
        return out

    def commit(self, messages: list[Staged | None]) -> None:
        files, root = self._files()
        from pyarrow.fs import FileType

        for m in messages:
            for name in m.names if m else ():
                target = f"{root}/{name}{SUFFIX}"
                if files.get_file_info(target).type != FileType.NotFound:
                    files.delete_dir(target)
                files.move(f"{root}/{m.folder}/{name}{SUFFIX}", target)
        if files.get_file_info(f"{root}/{self.staging}").type != FileType.NotFound:
            files.delete_dir(f"{root}/{self.staging}")

    def abort(self, messages: list[Staged | None]) -> None:
        from pyarrow.fs import FileType

        files, root = self._files()
        if files.get_file_info(f"{root}/{self.staging}").type != FileType.NotFound:
            files.delete_dir(f"{root}/{self.staging}")


class BundleSource(DataSource):
    """``df.write.format("exam_bundles").option("header", ...).mode("append").save(uri)`` with rows of SCHEMA; the folder is a URI that all executors reach."""

    @classmethod
    def name(cls) -> str:
        return "exam_bundles"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> BundleWriter:
        return BundleWriter(self.options["path"], self.options.get("header", ""))


def bundle_rows(lines: DataFrame, pictures: DataFrame) -> DataFrame:
    """Rows of SCHEMA, of (name, pos, line) and (name, path, content): each bundle in one task, its lines in order and then its pictures.

    Names are unique up to case (``review.bundle_names``). A bundle without lines has no table and is left out with its pictures. Rows are streamed, so a bundle
    may be of any size.
    """
    table = lines.select("name", F.col("pos").cast("long").alias("place"), F.lit(None).cast("string").alias("path"), "line", F.lit(None).cast("binary").alias("content"))
    known = pictures.join(lines.select("name").distinct(), "name", "left_semi")
    crops = known.select("name", F.lit((1 << 62)).cast("long").alias("place"), "path", F.lit(None).cast("string").alias("line"), "content")
    return table.unionByName(crops).repartition("name").sortWithinPartitions("name", "place", "path")


def write_bundles(lines: DataFrame, pictures: DataFrame, uri: str, header: str) -> None:
    """``<name> Cx/<name> Cx.csv`` with a byte order mark and CRLF behind every line, and ``<name> Cx/images/...``. A bundle that is there already is replaced."""
    lines.sparkSession.dataSource.register(BundleSource)
    bundle_rows(lines, pictures).write.format("exam_bundles").option("header", header).mode("append").save(uri)


#: The format's name and version.
FORMAT, VERSION = "exam-store", 1


class SnapshotError(ValueError):
    """``reason``: not-a-backup or newer-version."""

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def write_snapshot(tables: dict[str, DataFrame], path: str, scope: str = "work", created_at: int = 0, version: int = VERSION) -> None:
    """The tables beside ``path``, renamed to it when the last one and the manifest are written; a snapshot that is there is an error."""
    spark = next(iter(tables.values())).sparkSession
    draft = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    fs, target = _place(spark, path)
    _, source = _place(spark, draft)
    if fs.exists(target):
        raise FileExistsError(path)
    try:
        for name, df in tables.items():
            df.write.parquet(f"{draft}/{name}")
        counts = {name: spark.read.parquet(f"{draft}/{name}").count() for name in tables}
        manifest = json.dumps({"format": FORMAT, "version": version, "scope": scope, "created_at": created_at, "tables": counts})
        spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{draft}/manifest")
        if not fs.rename(source, target):
            raise FileExistsError(path)
    finally:
        if fs.exists(source):
            fs.delete(source, True)


def read_manifest(spark: SparkSession, path: str) -> dict:
    """Format, version, scope, created_at and rows of each table. What is no snapshot, or newer than this code, is refused."""
    fs, place = _place(spark, f"{path}/manifest/_SUCCESS")
    if not fs.exists(place):
        raise SnapshotError("not-a-backup")
    try:
        m = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    except (ValueError, TypeError):
        raise SnapshotError("not-a-backup") from None
    if not isinstance(m, dict) or m.get("format") != FORMAT or not isinstance(m.get("version"), (int, float)):
        raise SnapshotError("not-a-backup")
    if m["version"] > VERSION:
        raise SnapshotError("newer-version")
    return {**m, "scope": "everything" if m.get("scope") == "everything" else "work", "tables": m.get("tables") or {}}


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a snapshot."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in read_manifest(spark, path)["tables"]}
