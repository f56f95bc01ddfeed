"""Exams as lines of text, with page banners, numbered questions and lettered options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examloom.functions.text import trim
from examloom.order import with_last
from examloom.rounds import reached
from examloom.storage import materialize

#: A page's banner, lines that are headers or footers, a line that may start a question, and options, one or four on a line.
BANNER = r"(?i)^===\s+PAGE\s+(\d+)\s+===$"
NOISE = r"^© UCLES 2020|0610/12|0610/22|\[Turn over"
NUMBERED = r"^(\d+)\s+(.+)$"
OPTION = r"^([A-D])\s+(.+)$"
FOUR_OPTIONS = r"^A\s+(.+?)\s+B\s+(.+?)\s+C\s+(.+?)\s+D\s+(.+)$"


def _clean(c: Column) -> Column:
    return trim(F.regexp_replace(c, "[ \t]+", " "))


def parsed_exam(lines: DataFrame, noise: str = NOISE) -> DataFrame:
    """(file, number, id, page, question, options) of ``lines`` (file, line, text).

    A numbered line starts a question only if its number is the next one. The lines that do form a chain from the first line with 1: behind each
    stands the next line with the number after it. So each candidate points to its successor, and the chain is followed by doubling; a file may be of
    any length. A question's own lines meet in one value, as its text does. Numbers of more than 18 digits start nothing.
    """
    bare = lines.select("file", "line", trim(F.col("text")).alias("text")).filter("text <> ''")
    banner = F.when(F.col("text").rlike(BANNER), F.regexp_extract("text", BANNER, 1).try_cast("bigint"))
    paged = with_last(bare.withColumn("banner", banner), "file", [F.col("line").asc()], "banner").withColumn("page", F.coalesce("last", F.lit(1).cast("bigint"))).drop("last")
    page_number = F.coalesce(F.when(F.col("text").rlike(r"^\d+$"), F.col("text").try_cast("bigint")) == F.col("page"), F.lit(False))
    body = paged.filter(F.col("banner").isNull() & ~F.col("text").rlike(noise) & ~page_number).drop("banner")
    body = materialize(body.withColumn("n", F.when(F.col("text").rlike(NUMBERED), F.regexp_extract("text", NUMBERED, 1).try_cast("bigint"))))

    some = body.filter("n is not null").select("file", "line", "n")
    ask = some.select("file", F.col("line"), (F.col("n") + 1).alias("n"), F.lit(None).cast(some.schema["line"].dataType).alias("at"))
    behind = Window.partitionBy("file", "n").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    seen = some.withColumn("at", F.col("line")).unionByName(ask).withColumn("next", F.first("at", True).over(behind)).filter("at is null")
    node = lambda c: F.struct("file", F.col(c).alias("line"))
    links = seen.select(node("line").alias("node"), F.when(F.col("next").isNotNull(), node("next")).alias("next"))
    heads = some.filter("n = 1").groupBy("file").agg(F.min("line").alias("line")).select(node("line").alias("node"))
    starts = reached(links, heads).select("node.file", "node.line", F.lit(True).alias("starts"))

    marked = body.join(starts, ["file", "line"], "left").withColumn("number", F.when(F.col("starts"), F.col("n")))
    held = with_last(marked, "file", [F.col("line").asc()], "number").filter("last is not null")
    four = F.array(*(_clean(F.regexp_extract("text", FOUR_OPTIONS, k)) for k in range(1, 5)))
    kind = F.when(F.col("starts"), "start").when(F.col("text").rlike(FOUR_OPTIONS), "four").when(F.col("text").rlike(OPTION), "option").otherwise("more")
    text = F.when(F.col("starts"), F.regexp_extract("text", NUMBERED, 2)).when(F.col("kind") == "option", F.regexp_extract("text", OPTION, 2)).otherwise(F.col("text"))
    held = held.withColumn("kind", kind).withColumn("four", F.when(F.col("kind") == "four", four)).withColumn("text", _clean(text))
    one = held.groupBy("file", F.col("last").alias("number")).agg(F.array_sort(F.collect_list(F.struct("line", "kind", "text", "four", "page"))).alias("ls"))

    def add(a: Column, x: Column) -> Column:
        begun = F.size(a["options"]) > 0
        question = F.when((x["kind"] == "more") & ~begun, F.concat(a["question"], F.lit("\n"), x["text"])).otherwise(a["question"])
        longer = F.concat(F.slice(a["options"], F.lit(1), F.size(a["options"]) - 1), F.array(F.concat(F.element_at(a["options"], -1), F.lit(" "), x["text"])))
        options = F.when(x["kind"] == "four", x["four"]).when(x["kind"] == "option", F.concat(a["options"], F.array(x["text"]))).when(begun, longer).otherwise(a["options"])
        return F.struct(question.alias("question"), options.alias("options"))

    first = F.get("ls", F.lit(0))
    read = F.aggregate(F.slice("ls", F.lit(2), F.size("ls")), F.struct(first["text"].alias("question"), F.array().cast("array<string>").alias("options")), add)
    digits = F.col("number").cast("string")
    name = F.concat(F.lit("q"), F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits))
    return one.select("file", "number", name.alias("id"), first["page"].alias("page"), read.alias("r")).select("file", "number", "id", "page", "r.*")


def with_key(questions: DataFrame, key: DataFrame) -> DataFrame:
    """Questions with ``answer``, the index of their letter in ``key`` (file, number, letter); null without one, or for a letter behind D."""
    index = F.array_position(F.array(*map(F.lit, "ABCD")), F.col("letter")) - 1
    one = key.groupBy("file", "number").agg(F.min("letter").alias("letter"))
    return questions.join(one, ["file", "number"], "left").withColumn("answer", F.when(index >= 0, index)).drop("letter")
