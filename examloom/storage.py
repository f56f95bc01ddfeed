"""Shared scratch tables: how an operator cuts lineage without relying on any one machine's disk."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Whether Parquet columns are made of what variants hold.
APART = "spark.sql.variant.inferShreddingSchema"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a local session (tests) gets a new folder of its own, as all its tasks run on this machine; a cluster has to name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _OWN[app]


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt to all cores by ``key``: short rows that become long texts lie in few, small files, whose tasks would make all the texts."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it back.

    The result has no lineage behind it: a lost executor costs a reread, not a recomputation. Results read these tables for as long
    as the application lasts, so they are deleted when it ends. Variants are written as they are: taken apart under a schema of what they hold, they would have to be put together again by each reader.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/examloom-{uuid.uuid4().hex}"
    before = spark.conf.get(APART)
    spark.conf.set(APART, "false")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(APART, before)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
