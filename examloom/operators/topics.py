"""Topic matching and matching questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examloom.functions import text as tx

SPLIT_MARK = "~m"


def validated_matches(requested: DataFrame, response: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Each requested row_id with its topic and subtopic, or why they can't be used. Of several answers to a row the last counts (``seq``, where there is one)."""
    if "seq" in response.columns:
        response = response.groupBy("row_id").agg(F.max_by(F.struct("topic", "subtopic"), "seq").alias("m")).select("row_id", "m.*")
    known = taxonomy.select("topic").distinct().withColumn("listed", F.lit(True))
    pairs = taxonomy.select("topic", "subtopic").distinct().withColumn("paired", F.lit(True))
    r = requested.select("row_id").join(response, "row_id", "left").join(known, "topic", "left").join(pairs, ["topic", "subtopic"], "left")
    status = (
        F.when(F.col("topic").isNull(), "no_match")
        .when((F.col("topic") == "") & (F.col("subtopic") != ""), "subtopic_without_topic")
        .when(F.col("topic") == "", "unsure")
        .when(F.col("listed").isNull(), "topic_not_listed")
        .when((F.col("subtopic") != "") & F.col("paired").isNull(), "subtopic_not_listed")
        .otherwise("ok")
    )
    return r.select("row_id", F.coalesce("topic", F.lit("")).alias("topic"), F.coalesce("subtopic", F.lit("")).alias("subtopic"), status.alias("status"))


def usable(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("status").isin("ok", "unsure")).select(F.col("row_id").alias("doc_id"), "topic", "subtopic")


def with_topics(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """A row without a match has a blank topic."""
    return rows.join(matches, "doc_id", "left").withColumn("topic", F.coalesce("topic", F.lit(""))).withColumn("subtopic", F.coalesce("subtopic", F.lit("")))


def pending(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """J23."""
    return rows.join(matches, "doc_id", "left_anti")


def split_rows(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """A row with a valid split becomes a row per item, blank, in its place; others stay.

    ``splits``: (run_id, id, items, choices). Two of each at least, and all must stand in the row's own text.
    """
    r = rows.join(splits, ["run_id", "id"], "left")
    own = tx.squeezed(F.concat_ws(" ", "question", F.array_join("options", " ")))
    verbatim = lambda spans: F.forall(spans, lambda x: (tx.squeezed(x) != "") & own.contains(tx.squeezed(x)))
    ok = F.coalesce((F.size("items") >= 2) & (F.size("choices") >= 2) & verbatim(F.col("items")) & verbatim(F.col("choices")), F.lit(False))
    r = r.withColumn("split", ok)
    whole = r.filter(~F.col("split")).withColumn("part", F.lit(0))
    parts = r.filter("split").select("*", F.posexplode("items").alias("i", "item")).withColumn("part", F.col("i") + 1)
    parts = (
        parts.withColumn("id", F.concat("id", F.lit(SPLIT_MARK), F.col("part").cast("string")))
        .withColumn("question", F.concat(F.lit("Match: "), "item"))
        .withColumn("options", F.col("choices"))
        .withColumn("correct_index", F.lit(""))
        .withColumn("needs_review", F.when(F.col("needs_review") != "", F.col("needs_review")).otherwise("matching_split"))
    )
    columns = [*rows.columns, "part"]
    return whole.select(columns).unionByName(parts.select(columns))
