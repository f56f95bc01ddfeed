"""Exports with the columns that are set, review lists, folders, day tallies and what operations did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examloom.functions import text as tx
from examloom.operators.narrowing import let, number_at, string_at
from examloom.operators.review import matches as _matches

#: The exported columns in their order, and the header that differs from its column.
EXPORTED = ("topic", "subtopic", "year", "source", "question", "options", "correct_index", "image_urls")
HEADERS = {"image_urls": "image_url"}
#: Fixed value: what a folder without a name is called.
UNTITLED = "Untitled folder"


def export_flags(runs: DataFrame, listed: DataFrame, edited: DataFrame) -> DataFrame:
    """``runs`` (run_id, year_mode, typed_year) with topics and year, whether their columns are exported, and stamp, what stands in the year where no edit does.

    ``listed``: (run_id) runs with a topic list; ``edited``: (run_id, topics, year) of ``edits.columns_set``. A typed year stamps all rows; where the machine's years aren't
    wanted but an edit gives one, the others are blank; a null stamp leaves a row its own.
    """
    r = runs.join(listed.select("run_id", F.lit(True).alias("has_list")).distinct(), "run_id", "left").join(edited.select("run_id", F.col("topics").alias("edits_topic"), F.col("year").alias("edits_year")), "run_id", "left")
    said = lambda c: F.coalesce(F.col(c), F.lit(False))
    typed = F.when(F.col("year_mode") == "type", F.coalesce("typed_year", F.lit(""))).otherwise("")
    is_ai = F.coalesce(F.col("year_mode") == "ai", F.lit(False))
    return r.select(
        "run_id", (said("has_list") | said("edits_topic")).alias("topics"), (is_ai | (typed != "") | said("edits_year")).alias("year"),
        F.when(typed != "", typed).when(~is_ai & said("edits_year"), "").alias("stamp"),
    )


def _line(cells: dict[str, Column]) -> Column:
    """Cells joined by commas; the columns that a run doesn't export are null and fall out."""
    given = {"topic": F.col("topics"), "subtopic": F.col("topics"), "year": F.col("year_given")}
    return F.concat_ws(",", *(F.when(given[c], tx.csv_field(v)) if c in given else tx.csv_field(v) for c, v in cells.items()))


def export_lines(rows: DataFrame, flags: DataFrame) -> DataFrame:
    """(run_id, pos, line): each run's rows under its own columns, headers at position -1. ``rows``: run_id, pos and EXPORTED, of which options and image_urls are arrays; edits come later than stamps, so
    ``edited_year`` (null: none) wins over a stamp.
    """
    f = flags.select("run_id", "topics", F.col("year").alias("year_given"), "stamp")
    r = rows.join(f, "run_id").withColumn("year", F.coalesce("edited_year", "stamp", "year"))
    cells = {c: F.to_json(c) if c in ("options", "image_urls") else F.coalesce(F.col(c), F.lit("")) for c in EXPORTED}
    body = r.select("run_id", F.col("pos").cast("long").alias("pos"), _line(cells).alias("line"))
    head = f.join(rows.select("run_id").distinct(), "run_id", "left_semi").select("run_id", F.lit(-1).cast("long").alias("pos"), _line({c: F.lit(HEADERS.get(c, c)) for c in EXPORTED}).alias("line"))
    return head.unionByName(body)


def review_list(rows: DataFrame, query: str = "", unresolved: Column | None = None) -> DataFrame:
    """Rows that need review (where ``unresolved`` is given) and whose question or options hold the text; a number is a jump and filters nothing, nor does a blank."""
    shown = rows if unresolved is None else rows.filter(unresolved)
    return shown if query.strip().isdigit() else _matches(shown, query)


def narrowed_answer(value: Column, options: Column) -> Column:
    """struct<source, index, confidence, evidence, demoted> of a manifest's answer (a variant): an answer without a valid index is none, and told; a reasoned one is likely if it doesn't say."""
    n = number_at(value, "$.index")
    index = let(n, lambda x: F.when((x == F.floor(x)) & (x >= 0) & (x < F.size(options)), x.cast("int")))
    said = string_at(value, "$.source")
    source = F.when(said.isin("extracted", "reasoned"), said).otherwise("none")
    demoted = (source != "none") & index.isNull()
    kind = F.when(demoted, "none").otherwise(source)
    sure = string_at(value, "$.confidence")
    return F.struct(
        kind.alias("source"), F.when(~demoted, index).alias("index"), F.when(kind == "reasoned", F.when(sure.isin("certain", "unsure"), sure).otherwise("likely")).alias("confidence"),
        F.when(kind != "none", string_at(value, "$.evidence")).alias("evidence"), F.coalesce(demoted, F.lit(False)).alias("demoted"),
    )


def import_summary(rows: DataFrame) -> DataFrame:
    """Per run, questions, extracted answers, answers that await approval, and flagged rows. ``rows``: run_id, correct_index, needs_review, awaiting (boolean)."""
    blank = F.col("correct_index") == ""
    return rows.groupBy("run_id").agg(
        F.count("*").alias("questions"), F.count_if(~blank).alias("extracted"), F.count_if(F.col("awaiting")).alias("awaiting"), F.count_if(blank | (F.col("needs_review") != "")).alias("flagged")
    )


def _tallies(counted: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table."""
    parts = None
    for name, df in counted.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        parts = one if parts is None else parts.unionByName(one)
    return parts.agg(*(F.sum(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in counted))


def restore_outcome(jobs: DataFrame, runs: DataFrame, artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """One row: folders, runs, artifacts, files and skipped of a restored backup. Runs and files need their job, artifacts a restored run."""
    there = jobs.select("job_id", F.lit(1).alias("ok")).distinct()
    r, f = (df.join(there, "job_id", "left") for df in (runs, files))
    a = artifacts.select("run_id").join(r.filter("ok = 1").select("run_id", "ok").distinct(), "run_id", "left")
    return _tallies(
        {
            "folders": jobs.filter("kind = 'folder'"), "runs": r.filter("ok = 1"), "artifacts": a.filter("ok = 1"), "files": f.filter("ok = 1"),
            "skipped": r.filter("ok is null").select("ok").unionByName(a.filter("ok is null").select("ok")).unionByName(f.filter("ok is null").select("ok")),
        }
    )


def folder_outcomes(targets: DataFrame, failures: DataFrame) -> DataFrame:
    """Per folder, how many members were matched, of how many, and its first failure. ``targets``: job_id, run_id, action (``store.matching_targets``); ``failures``: run_id, reason."""
    t = targets.join(failures.groupBy("run_id").agg(F.min("reason").alias("reason")), "run_id", "left")
    asked = F.col("action") == "match"
    return t.groupBy("job_id").agg(F.count_if(asked & F.col("reason").isNull()).alias("matched"), F.count_if(asked).alias("total"), F.min_by("reason", F.when(asked & F.col("reason").isNotNull(), F.col("run_id"))).alias("failure"))


def pending_topics(runs: DataFrame, listed: DataFrame, pending: DataFrame) -> DataFrame:
    """Per job, rows of finished runs that still lack a topic; runs without a topic list count nothing. ``pending``: run_id, pending."""
    done = runs.filter("status = 'done'").join(listed.select("run_id").distinct(), "run_id", "left_semi").join(pending, "run_id", "left")
    every = runs.select("job_id").distinct()
    return every.join(done.groupBy("job_id").agg(F.sum("pending").alias("pending")), "job_id", "left").select("job_id", F.coalesce("pending", F.lit(0)).alias("pending"))


def backup_contents(jobs: DataFrame, runs: DataFrame, current_job) -> DataFrame:
    """One row: folders, runs, and whether anything is worth a backup: a folder, or a run of another job than the current one."""
    others = runs.filter(~F.col("job_id").eqNullSafe(F.lit(current_job)))
    found = _tallies({"folders": jobs.filter("kind = 'folder'"), "runs": runs, "others": others})
    return found.select("folders", "runs", ((F.col("folders") > 0) | (F.col("others") > 0)).alias("backable"))


def created_folders(names: DataFrame) -> DataFrame:
    """(job_id, kind, name, keep_original) of (job_id, name): trimmed, and named where blank."""
    name = tx.trim(F.coalesce("name", F.lit("")))
    return names.select("job_id", F.lit("folder").alias("kind"), F.when(name == "", UNTITLED).otherwise(name).alias("name"), F.lit(True).alias("keep_original"))


def renamed_folders(jobs: DataFrame, names: DataFrame) -> DataFrame:
    """``jobs`` under new names (job_id, new_name); a blank one changes nothing."""
    new = names.select("job_id", tx.trim(F.col("new_name")).alias("new_name")).filter("new_name <> ''").groupBy("job_id").agg(F.max("new_name").alias("new_name"))
    return jobs.join(new, "job_id", "left").withColumn("name", F.coalesce("new_name", "name")).select(*jobs.columns)


def with_exclusions(runs: DataFrame, flags: DataFrame) -> DataFrame:
    """``runs`` whose ``excluded`` is what ``flags`` (run_id, new_excluded) say, where they say anything."""
    return runs.join(flags.groupBy("run_id").agg(F.bool_or("new_excluded").alias("new_excluded")), "run_id", "left").withColumn("excluded", F.coalesce("new_excluded", "excluded")).select(*runs.columns)


def tallied(stored: DataFrame, requests: DataFrame, resets: DataFrame) -> DataFrame:
    """(key, day, model, requests): the tally of each key's newest day after ``requests`` (key, day, model, requests) and ``resets`` (key, day).

    A tally of an earlier day is void, and so is what was counted up to a reset of its day or a later one; models without requests have no row.
    """
    columns = ("key", "day", "model", "requests")
    both = stored.select(*columns, F.lit(True).alias("old")).unionByName(requests.select(*columns, F.lit(False).alias("old")))
    last = both.select("key", "day").unionByName(resets.select("key", "day")).groupBy("key").agg(F.max("day").alias("last"))
    cleared = resets.groupBy("key").agg(F.max("day").alias("reset"))
    kept = both.join(last, "key").filter("day = last").join(cleared, "key", "left").filter("not old or reset is null or reset < day")
    return kept.groupBy("key", "day", "model").agg(F.sum("requests").alias("requests"))
