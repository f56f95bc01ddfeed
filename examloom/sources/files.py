"""Scans and sinks: page text, responses, topic lists, line-oriented exams, manifests, CSV (S3, S12, S19, S21, S23, S26, S27); line-oriented exams are in ``exams``, PDF files in ``pdf``, bundles and snapshots in ``bundles``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from examloom.operators import narrowing
from examloom.functions.text import trim

EXAM = T.StructType([
    T.StructField("sourceFile", T.StringType()),
    T.StructField("producedBy", T.StringType()),
    T.StructField("pages", T.ArrayType(T.StructType([T.StructField("page", T.IntegerType()), T.StructField("file", T.StringType())]))),
    T.StructField("questions", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("question", T.StringType()), T.StructField("options", T.ArrayType(T.StringType())),
        T.StructField("page", T.IntegerType()), T.StructField("figures", T.ArrayType(T.StringType())),
        T.StructField("answer", T.StructType([T.StructField("kind", T.StringType()), T.StructField("index", T.IntegerType()), T.StructField("confidence", T.StringType())])),
    ]))),
])


def page_text(pages: DataFrame) -> DataFrame:
    """S3: text layers with runs of blanks and tabs made one blank; a missing layer is empty."""
    return pages.withColumn("text", F.coalesce(F.regexp_replace("text", "[ \t]+", " "), F.lit("")))


def parsed_responses(responses: DataFrame) -> DataFrame:
    """Raw answers of a model as variants: one code fence falls away, what can't be parsed is null with ``bad`` set."""
    return narrowing.read_responses(responses).withColumn("bad", F.col("value").isNull())


def topic_list(lines: DataFrame) -> DataFrame:
    """(file, line, text) to (file, topic, subtopic): indented lines are subtopics of the last topic above; the first line is a topic in any case."""
    kept = lines.withColumn("indented", F.col("text").rlike(r"^[ \t]")).withColumn("text", trim(F.col("text"))).filter("text <> ''")
    order = Window.partitionBy("file").orderBy("line")
    kept = kept.withColumn("indented", F.col("indented") & (F.row_number().over(order) > 1))
    above = order.rowsBetween(Window.unboundedPreceding, 0)
    topic = F.last(F.when(~F.col("indented"), F.col("text")), ignorenulls=True).over(above)
    kept = kept.withColumn("above", topic)
    sub = F.col("indented")
    return kept.select("file", "line", F.when(sub, F.col("above")).otherwise(F.col("text")).alias("topic"), F.when(sub, F.col("text")).otherwise("").alias("subtopic"))


def narrowed_topics(topics: DataFrame, most_topics: int = 300, most_subtopics: int = 50) -> DataFrame:
    """Distinct topics and subtopics in order of appearance, up to the format's limits."""
    t = topics.groupBy("file", "topic", "subtopic").agg(F.min("line").alias("line"))
    first = F.min("line").over(Window.partitionBy("file", "topic"))
    t = t.withColumn("first", first).withColumn("topic_rank", F.dense_rank().over(Window.partitionBy("file").orderBy("first")))
    named = F.when(F.col("subtopic") != "", 1).otherwise(0)
    t = t.withColumn("sub_rank", F.sum(named).over(Window.partitionBy("file", "topic").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    return t.filter((F.col("topic_rank") <= most_topics) & (F.col("sub_rank") <= most_subtopics)).select("file", "line", "topic", "subtopic")


def exam_lines(lines: DataFrame) -> DataFrame:
    """(file, line, text) to (file, number, question, options): a numbered line counts only if its number is the next one.

    The state runs through a file, which is one document.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        import re

        out, number = [], 0
        for text in group.sort_values("line")["text"]:
            text = text.strip()
            head = re.match(r"(?:Q\s*)?(\d{1,3})\s*[.)]\s+(.*)", text)
            option = re.match(r"\(?([A-Ea-e])[.)]\s+(.*)", text)
            if head and int(head[1]) == number + 1:
                number += 1
                out.append([number, head[2], []])
            elif not out or not text:
                continue
            elif option:
                out[-1][2].append(option[2])
            elif out[-1][2]:
                out[-1][2][-1] += " " + text
            else:
                out[-1][1] += " " + text
        frame = pd.DataFrame(out, columns=["number", "question", "options"])
        frame.insert(0, "file", group["file"].iloc[0])
        return frame

    return lines.groupBy("file").applyInPandas(fold, "file string, number int, question string, options array<string>")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Every ``exam.json`` under a folder; unreadable ones have null fields."""
    return spark.read.schema(EXAM).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "exam.json").json(path).withColumn("path", F.col("_metadata.file_path"))


def usage_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; malformed ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Quotes where needed and doubled inside, CRLF behind every line, empty fields left empty."""
    rows.write.option("header", "true").option("escape", '"').option("lineSep", "\r\n").option("emptyValue", "").option("nullValue", "").csv(path)
