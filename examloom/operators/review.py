"""Review and export views over overlays."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examloom.functions import text as tx
from examloom.operators.answers import index_of


def flag_category(reason: Column, answer: Column) -> Column:
    """The order of the tests is the rule."""
    r = F.lower(reason)
    has = lambda *words: F.greatest(*(r.contains(w) for w in words), F.lit(False))
    return (
        F.when(has("not_mcq"), "not-mcq")
        .when(has("conflict", "multiple_mark"), "conflicting-marks")
        .when(has("label", "option", "length"), "length-mismatch")
        .when(has("unclear", "illegible", "unreadable", "empty", "low_confidence") | (answer != ""), "low-confidence")
        .otherwise("blank-answer")
    )


def is_flagged() -> Column:
    """P1."""
    return (F.col("correct_index") == "") | (F.col("needs_review") != "")


def in_range(pick: Column) -> Column:
    return F.coalesce((pick >= 0) & (pick < F.size("options")), F.lit(False))


def resolved(rows: DataFrame, picks: DataFrame) -> DataFrame:
    """A valid pick is the answer and clears the flag. ``picks``: (doc_id, pick)."""
    r = rows.join(picks, "doc_id", "left")
    ok = in_range(F.col("pick"))
    return r.withColumn("correct_index", F.when(ok, F.col("pick").cast("string")).otherwise(F.col("correct_index"))).withColumn("needs_review", F.when(ok, "").otherwise(F.col("needs_review"))).withColumn("resolved", ok).drop("pick")


def edited(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """J20, content: an edit's question where it has one."""
    return rows.join(edits.select("doc_id", "new_question"), "doc_id", "left").withColumn("question", F.coalesce("new_question", "question")).drop("new_question")


def edited_meta(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """J20, meta: an edit's topic where it has one, else the row's."""
    topic = F.col("topic") if "topic" in rows.columns else F.lit("")
    return rows.join(edits.select("doc_id", "new_topic"), "doc_id", "left").withColumn("topic", F.coalesce("new_topic", topic)).drop("new_topic")


def without_deleted(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """J21."""
    return rows.join(deleted, "doc_id", "left_anti")


def with_added(rows: DataFrame, added: DataFrame) -> DataFrame:
    """Added rows are blank and come last."""
    blank = {"question": "", "correct_index": "", "needs_review": "", "year": "", "image_url": ""}
    a = added.select("run_id", "id", F.lit(None).cast("long").alias("doc_id"), F.lit(1 << 30).alias("pos"), F.array().cast("array<string>").alias("options"), *(F.lit(v).alias(k) for k, v in blank.items()))
    return rows.unionByName(a, allowMissingColumns=True)


def reviewed(rows: DataFrame, added: DataFrame, deleted: DataFrame, edits: DataFrame, picks: DataFrame) -> DataFrame:
    """Additions, deletions, content edits, resolutions, in this order."""
    return resolved(edited(without_deleted(with_added(rows, added), deleted), edits), picks)


def review_rows(rows: DataFrame, planned: DataFrame, added: DataFrame, deleted: DataFrame, edits: DataFrame) -> DataFrame:
    """The review view, numbered anew, with each row's page and category."""
    r = edited(without_deleted(with_added(rows, added), deleted), edits)
    r = r.join(planned.select("run_id", F.col("id").alias("parent"), "page"), (r["run_id"] == planned["run_id"]) & (tx.parent_row(r["id"]) == F.col("parent")), "left").drop(planned["run_id"], "parent")
    number = F.row_number().over(Window.partitionBy("run_id").orderBy("pos", "id"))
    return r.withColumn("question_number", number).withColumn("category", F.when(is_flagged(), flag_category(F.col("needs_review"), F.col("correct_index"))))


def answer_source(rows: DataFrame, picks: DataFrame, ai: DataFrame) -> DataFrame:
    """Human, then extracted, then machine answer, each only if it is one of the options."""
    r = rows.join(picks, "doc_id", "left").join(ai, "doc_id", "left").withColumn("own", index_of(F.col("correct_index")))
    human, own, machine = (in_range(F.col(c)) for c in ("pick", "own", "ai"))
    r = r.withColumn("source", F.when(human, "human").when(own, "extracted").when(machine, "ai").otherwise("none"))
    return r.withColumn("answer", F.when(human, F.col("pick")).when(own, F.col("own")).when(machine, F.col("ai")))


def ai_plan(rows: DataFrame, picks: DataFrame, ai: DataFrame) -> DataFrame:
    """Per run, what taking the machine's answers would fill, change or leave."""
    r = rows.join(ai, "doc_id").join(picks, "doc_id", "left").withColumn("own", index_of(F.col("correct_index")))
    now = F.when(in_range(F.col("pick")), F.col("pick")).when(in_range(F.col("own")), F.col("own"))
    sure = in_range(F.col("ai")) & (F.col("confidence") != "unsure")
    kind = F.when(~sure, "unsure").when(now.isNull(), "fill").when(now == F.col("ai"), "agree").otherwise("differ")
    return r.withColumn("kind", kind).groupBy("run_id").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("fill", "differ", "agree", "unsure")))


def matches(rows: DataFrame, query: str) -> DataFrame:
    """Rows whose question or options contain the text; a number jumps to a position instead."""
    q = query.strip().lower()
    if not q:
        return rows
    if q.isdigit():
        return rows.filter(F.col("pos") == int(q))
    return rows.filter(F.lower("question").contains(q) | F.exists("options", lambda o: F.lower(o).contains(q)))


def export_rows(reviewed_rows: DataFrame, topics: DataFrame, edits: DataFrame, source_names: Column, year_mode: str = "ai", typed_year: str = "") -> DataFrame:
    """Unflagged rows in the exported columns; topics and year before meta edits."""
    r = reviewed_rows.filter(~is_flagged()).join(topics, "doc_id", "left")
    r = r.withColumn("topic", F.coalesce("topic", F.lit(""))).withColumn("subtopic", F.coalesce("subtopic", F.lit("")))
    if typed_year:
        r = r.withColumn("year", F.lit(typed_year))
    elif year_mode != "ai":
        r = r.withColumn("year", F.lit(""))
    r = edited_meta(r, edits)
    images = F.when(F.col("image_url") == "", F.array().cast("array<string>")).otherwise(F.array("image_url"))
    return r.select("run_id", "pos", "id", "topic", "subtopic", "year", source_names.alias("source"), "question", F.to_json("options").alias("options"), "correct_index", F.to_json(images).alias("image_url"))


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(run_id, pos, line), quoted where needed."""
    return rows.select("run_id", "pos", "id", F.concat_ws(",", *(tx.csv_field(F.col(c)) for c in columns)).alias("line"))


def bundle_names(files: DataFrame) -> DataFrame:
    """W5 for names without a number of their own: the second of equal names (but for case) is ``name-2``, and so on."""
    base = files.withColumn("base", tx.safe_bundle_name(F.col("file_name")))
    n = F.row_number().over(Window.partitionBy(F.lower("base")).orderBy("seq"))
    return base.withColumn("n", n).withColumn("name", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("n").cast("string"))))


def bundle_names_exactly(files: DataFrame, batch: str) -> DataFrame:
    """Each name probes what its batch has taken, so order matters within a batch (one export)."""
    base = files.select(batch, "seq", tx.safe_bundle_name(F.col("file_name")).alias("base"))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        taken, names = set(), []
        group = group.sort_values("seq")
        for b in group["base"]:
            name, n = b, 2
            while name.lower() in taken:
                name, n = f"{b}-{n}", n + 1
            taken.add(name.lower())
            names.append(name)
        return group.assign(name=names)[[batch, "seq", "name"]]

    return base.groupBy(batch).applyInPandas(fold, f"{batch} {dict(base.dtypes)[batch]}, seq long, name string")
