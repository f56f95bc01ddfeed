"""Bounded samples of labelled rows, for fitting the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remainder(doc_id: str, k: int) -> Column:
    """crc32 of the id's text modulo ``k``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(k))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_bytes: int) -> DataFrame:
    """(doc_id, label, text): labelled documents of every class of ``labels`` (doc_id, ``label``), those with the least id hashes.

    A class has at most ``per_class`` documents and, behind its first, ``most_bytes`` bytes of text; it takes documents of any length, in the order of
    the hashes, as long as these bounds hold. An id with several labels takes the greatest, an id with several texts the one with the
    least hash, so the sample is the same whatever the partitioning and however often a row is repeated.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    one = known.groupBy("doc_id").agg(F.max(label).alias("label"))
    order = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")
    # Of each partition, and then of all, only the first ``per_class`` ids of a class are kept.
    classes = [r["label"] for r in one.select("label").distinct().collect()]
    ids = None
    for c in sorted(classes):
        some = one.filter(F.col("label") == F.lit(c)).orderBy(order).limit(per_class)
        ids = some if ids is None else ids.unionByName(some)
    if ids is None:
        return docs.select("doc_id", F.lit(None).cast(one.schema["label"].dataType).alias("label"), "text").limit(0)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    # At most ``per_class`` rows of a class meet here.
    before = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))
    return rows.withColumn("spent", spent).filter((F.col("spent") == 0) | (F.col("spent") + F.octet_length("text") <= most_bytes)).drop("spent")
