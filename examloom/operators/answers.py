"""Answers: parsing, forcing, merging and validating rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examloom.functions import text as tx

EVIDENCE = ("separate_key", "inline_marks", "mixed")


def index_of(answer: Column) -> Column:
    """A digit string as a number, else null."""
    return F.when(answer.rlike(r"^\d+$"), answer.try_cast("int"))


def parsed_rows(rows: DataFrame) -> DataFrame:
    """Cleans options and answers; the first problem found stands where the row has no reason of its own."""
    options = F.filter(F.transform("options", tx.option_text), lambda o: o != "")
    r = rows.withColumn("options", options).withColumn("question", tx.trim(F.col("question"))).withColumn("given", tx.trim(F.col("correct_index")))
    ok = (F.col("given") == "") | F.coalesce(index_of(F.col("given")) < F.size("options"), F.lit(False))
    r = r.withColumn("correct_index", F.when(ok, F.col("given")).otherwise(""))
    reason = F.when(F.col("needs_review") != "", F.col("needs_review")).when(F.col("question") == "", "empty_question").when(F.size("options") < 2, "incomplete_options")
    reason = reason.when(~ok, "index_out_of_range").when(F.col("correct_index") == "", "no_visible_answer").otherwise("")
    return r.withColumn("needs_review", reason).drop("given")


def forced_answer(policy: Column, reason: Column, answer: Column, options: Column) -> Column:
    """struct<correct_index, needs_review>: document veto, row veto, blank, no number, out of range, accepted."""
    a = tx.trim(answer)
    out = lambda i, r: F.struct(i.alias("correct_index"), r.alias("needs_review"))
    blank = F.lit("")
    return (
        F.when(policy.isin("no_answer_key", "uncertain"), out(blank, policy))
        .when(reason != "", out(blank, reason))
        .when(a == "", out(blank, F.lit("no_visible_answer")))
        .when(~a.rlike(r"^\d+$"), out(blank, F.lit("key_unclear")))
        .when(F.coalesce(index_of(a) >= F.size(options), F.lit(True)), out(blank, F.lit("index_out_of_range")))
        .otherwise(out(index_of(a).cast("string"), blank))
    )


def merged_rows(planned: DataFrame, worker: DataFrame) -> DataFrame:
    """Planned rows with their worker row; fewer than two options is no question of choice."""
    w = worker.select("run_id", "id", "question", "options", "correct_index")
    m = planned.join(w, ["run_id", "id"]).withColumn("forced", forced_answer(F.col("policy"), F.col("reason"), F.col("correct_index"), F.col("options")))
    mcq = F.size("options") >= 2
    return m.select(
        "run_id", "id", "pos", tx.strip_question_label(F.col("question")).alias("question"), "options", "image_url", "page",
        F.when(mcq, F.col("forced.correct_index")).otherwise("").alias("correct_index"),
        F.when(mcq, F.col("forced.needs_review")).otherwise("not_mcq").alias("needs_review"),
    )


def merge_violations(planned: DataFrame, worker: DataFrame) -> DataFrame:
    """(run_id, id, violation) for repeated, unknown and missing ids."""
    counted = worker.groupBy("run_id", "id").agg(F.count("*").alias("copies"))
    both = planned.select("run_id", "id", F.lit(1).alias("known")).join(counted, ["run_id", "id"], "full_outer")
    what = F.array_compact(F.array(F.when(F.col("copies") > 1, "duplicate"), F.when(F.col("known").isNull(), "unknown"), F.when(F.col("copies").isNull(), "missing")))
    return both.select("run_id", "id", F.explode(what).alias("violation"))


def final_violations(rows: DataFrame, planned: DataFrame, crops: DataFrame) -> DataFrame:
    """What keeps merged rows from being imported. ``crops`` has (run_id, image_url)."""
    known = planned.select("run_id", "id", F.lit(True).alias("known"))
    made = crops.select("run_id", "image_url", F.lit(True).alias("made")).distinct()
    r = rows.join(known, ["run_id", "id"], "left").join(made, ["run_id", "image_url"], "left")
    bare = F.col("needs_review") == ""
    i = index_of(F.col("correct_index"))
    known = F.col("known").isNotNull()
    what = F.array_compact(
        F.array(
            F.when(~known, "not_planned"),
            F.when(known & bare & (tx.trim(F.col("question")) == ""), "empty_question"),
            F.when(known & bare & (F.size("options") == 0), "no_options"),
            F.when(known & (F.col("correct_index") != "") & i.isNull(), "not_a_number"),
            F.when(known & (i >= F.size("options")), "out_of_range"),
            F.when(known & (F.col("image_url") != "") & F.col("made").isNull(), "missing_crop"),
        )
    )
    return r.select("run_id", "id", F.explode(what).alias("violation"))


def final_flags(rows: DataFrame, cut: Column) -> DataFrame:
    """Options without labels, and the flag that wins. ``cut``: the row's list ran over the page."""
    r = rows.withColumn("bare", tx.strip_enumeration(F.col("options"))).withColumn("options", F.col("bare.options"))
    flag = F.when(F.size("options") < 2, "incomplete_options").when(cut, "options_cut_at_page_break").when(F.col("needs_review") != "", F.col("needs_review"))
    flag = flag.when(tx.trim(F.col("question")) == "", "empty_question").when(F.col("bare.ambiguous"), "possible_merge").otherwise("")
    return r.withColumn("needs_review", flag).drop("bare")


def modal_option_count(rows: DataFrame) -> DataFrame:
    """A4: (run_id, mode): the commonest number of options (two or more), the larger of equals; null below four rows or half of them."""
    hits = rows.withColumn("n", F.size("options")).groupBy("run_id", "n").agg(F.count("*").alias("hits")).withColumn("votes", F.when(F.col("n") >= 2, F.col("hits")))
    top = hits.groupBy("run_id").agg(F.sum("votes").alias("all"), F.max(F.when(F.col("n") >= 2, F.struct("hits", "n"))).alias("top"))
    ok = (F.col("all") >= 4) & (F.col("top.hits") * 2 >= F.col("all"))
    return top.select("run_id", F.when(ok, F.col("top.n")).alias("mode"))


def under_transcribed(rows: DataFrame, boundary: DataFrame) -> DataFrame:
    """Rows with fewer than two options, or at a page's end with fewer than the run's mode. ``boundary`` has (run_id, id)."""
    r = rows.join(modal_option_count(rows), "run_id").join(boundary.select("run_id", "id", F.lit(True).alias("last")).distinct(), ["run_id", "id"], "left")
    n = F.size("options")
    return r.filter((n < 2) | (F.coalesce("last", F.lit(False)) & (n < F.col("mode")))).select("run_id", "id", n.alias("n_options"))


def missed_inline(planned: DataFrame, rows: DataFrame) -> DataFrame:
    """Blank rows on pages where another row has an answer, in runs whose marks are on the page."""
    r = planned.filter(F.col("policy").isin("inline_marks", "mixed")).join(rows.select("run_id", "id", "options", "correct_index"), ["run_id", "id"])
    blank = tx.trim(F.col("correct_index")) == ""
    answered = r.filter(~blank).select("run_id", "page").distinct()
    return r.filter(blank & (F.size("options") >= 2) & (F.col("reason") == "")).join(answered, ["run_id", "page"], "left_semi").select("run_id", "id", "page")


def attach_key(rows: DataFrame, key: DataFrame) -> DataFrame:
    """Answers of a key (doc_id, pick), where a row has none and the pick is one of its options."""
    r = rows.join(key, "doc_id", "left")
    use = (tx.trim(F.col("correct_index")) == "") & (F.col("pick") < F.size("options"))
    r = r.withColumn("from_key", F.coalesce(use, F.lit(False)))
    return r.withColumn("correct_index", F.when(F.col("from_key"), F.col("pick").cast("string")).otherwise(F.col("correct_index"))).drop("pick")
