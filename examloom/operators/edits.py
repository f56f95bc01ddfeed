"""What reviewers change, and what is exported of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examloom.functions import text as tx

FIELDS = ("topic", "subtopic", "year")


def jump_index(rows: DataFrame, number: int) -> DataFrame:
    """Per run, the place from 0 of the row with a question number, -1 without one. ``rows``: run_id, question_number."""
    # The place of a number is how many are below it.
    n = F.col("question_number")
    there, below = F.max(n == number), F.count_if(n < number)
    return rows.groupBy("run_id").agg(F.when(there, below).otherwise(-1).cast("int").alias("index"))


def export_columns(topics: bool, year: bool) -> list[str]:
    """The exported columns under their headers."""
    return [*(("topic", "subtopic") if topics else ()), *(("year",) if year else ()), "source", "question", "options", "correct_index", "image_url"]


def columns_set(edits: DataFrame) -> DataFrame:
    """Per run, whether an edit gives a topic or a year, which then are exported. ``edits``: run_id, topic, subtopic, year; null: not edited."""
    given = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return edits.groupBy("run_id").agg(F.bool_or(given("topic") | given("subtopic")).alias("topics"), F.bool_or(given("year")).alias("year"))


def bulk_patch(selected: DataFrame, topic: str = "", subtopic: str = "", year: str = "", clear: tuple[str, ...] = ()) -> DataFrame:
    """An edit for each selected row with the fields that were filled; those in ``clear`` are set blank, the others stay null."""
    value = {"topic": topic.strip(), "subtopic": subtopic.strip(), "year": year.strip()}
    return selected.select("run_id", "row_id", *(F.lit(value[c] if value[c] else ("" if c in clear else None)).cast("string").alias(c) for c in FIELDS))


def merged_edits(stored: DataFrame, patch: DataFrame) -> DataFrame:
    """stored edits (run_id, row_id and fields) under a patch: a field that the patch has wins, a blank one is taken out, and an edit without fields goes."""
    p = patch.select("run_id", "row_id", *(F.col(c).alias(f"new_{c}") for c in FIELDS))
    both = stored.join(p, ["run_id", "row_id"], "full_outer")
    out = both.select("run_id", "row_id", *(F.nullif(F.coalesce(f"new_{c}", c), F.lit("")).alias(c) for c in FIELDS))
    return out.filter(F.coalesce(*FIELDS).isNotNull())


def archive_name(bundles: DataFrame, product: str) -> DataFrame:
    """one file's name for each export: its only bundle's, or the first one's and how many more. ``bundles``: export, seq, name."""
    b = bundles.groupBy("export").agg(F.min_by("name", "seq").alias("first"), F.count("*").alias("n"))
    more = F.when(F.col("n") > 1, F.concat(F.lit(" +"), (F.col("n") - 1).cast("string"), F.lit(" more"))).otherwise("")
    return b.select("export", F.concat("first", more, F.lit(f" {product}.zip")).alias("name"))


def save_plan(rows: DataFrame) -> DataFrame:
    """what saving an editor's form does. ``rows``: question, options and correct_index as first extracted; form_question, form_options
    (array<struct<text, was>>, was: an option's old index or null), choice (null: none), now_index (the answer before saving), stored (a pick or null), ai (an index or null).

    new_question, new_options and new_index are null where they are not changed; an answer follows its option, and a blank beats a stale one.
    resolution is keep, clear or the index that is set; new_ai is null where it stays.
    """
    texts = F.transform("form_options", lambda o: tx.trim(o["text"]))
    olds = F.transform("form_options", lambda o: o["was"])
    moved = lambda i: F.when(i.isNotNull() & F.array_contains(F.transform(olds, lambda o: F.coalesce(o, F.lit(-1))), i), F.array_position(F.transform(olds, lambda o: F.coalesce(o, F.lit(-1))), i) - 1)
    same_places = F.forall(F.transform("form_options", lambda o, i: F.coalesce(o["was"] == i, F.lit(False))), lambda x: x)
    structural = (F.size("form_options") != F.size("options")) | ~same_places
    old = F.when(F.col("now_index").rlike(r"^\d+$"), F.col("now_index").try_cast("int"))
    follows = F.when(structural & (F.col("now_index") != ""), F.coalesce(moved(old).cast("string"), F.lit(""))).otherwise(F.col("now_index"))
    index = F.when(F.col("choice").isNull(), "").otherwise(follows)
    r = rows.withColumn("structural", structural).withColumn("index", index)
    keeps = (F.col("index") != "") & (F.col("index").try_cast("int") == F.col("choice"))
    chosen = F.col("choice").cast("string")
    resolution = (
        F.when(F.col("choice").isNull(), F.when(F.col("stored").isNull(), "keep").otherwise("clear"))
        .when(F.col("stored").isNotNull(), F.when(F.col("stored") == F.col("choice"), "keep").otherwise(chosen))
        .otherwise(F.when(F.coalesce(keeps, F.lit(False)), "keep").otherwise(chosen))
    )
    question = tx.trim(F.col("form_question"))
    ai = F.when(F.col("structural") & F.col("ai").isNotNull() & ~moved(F.col("ai")).eqNullSafe(F.col("ai")), F.coalesce(moved(F.col("ai")).cast("int"), F.lit(-1)))
    return r.select(
        *rows.columns, F.when(question != F.col("question"), question).alias("new_question"), F.when(texts != F.col("options"), texts).alias("new_options"),
        F.when(F.col("index") != F.col("correct_index"), F.col("index")).alias("new_index"), resolution.alias("resolution"), ai.alias("new_ai"),
    )


def variant_grades(pairs: DataFrame) -> DataFrame:
    """Per variant, how many matched questions are exact, and how its answers do where the reference has an extracted one.

    ``pairs``: variant, and question, options, page, answer, figures of both sides as ref_* and got_*; an answer is null unless it was extracted.
    """
    same = lambda c: F.coalesce(c, F.lit(False))
    gradable = F.col("ref_answer").isNotNull()
    folds = lambda c: F.transform(c, tx.folded)
    counts = {
        "matched": F.lit(True), "text_exact": same(tx.folded(F.col("ref_question")) == tx.folded(F.col("got_question"))), "options_exact": same(folds("ref_options") == folds("got_options")), "page_exact": same(F.col("ref_page") == F.col("got_page")),
        "gradable": gradable, "answer_right": gradable & same(F.col("ref_answer") == F.col("got_answer")), "answer_wrong": gradable & same(F.col("ref_answer") != F.col("got_answer")), "answer_blank": gradable & F.col("got_answer").isNull(),
        "figures_missing": (F.size("ref_figures") > 0) & (F.size("got_figures") == 0),
    }
    out = pairs.groupBy("variant").agg(*(F.count_if(v).alias(k) for k, v in counts.items()))
    share = F.floor(F.try_divide(F.col("answer_right") * 100, F.col("gradable")) + 0.5)
    return out.withColumn("right_pct", F.when(F.col("gradable") == 0, "n/a").otherwise(F.concat(share.cast("long").cast("string"), F.lit("%"))))


def exam_questions(manifest_rows: DataFrame) -> DataFrame:
    """a bundle's question as an exam row: an extracted answer is the row's, any other is left to review; a missing flag is none."""
    extracted = (F.col("answer_source") == "extracted") & (F.col("answer_index") >= 0) & (F.col("answer_index") < F.size("options"))
    return manifest_rows.select("run_id", "id", "question", "options", F.when(extracted, F.col("answer_index").cast("string")).otherwise("").alias("correct_index"), F.coalesce("flag", F.lit("")).alias("needs_review"))
