"""Putting a plan together and checking what comes back for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examloom.functions import text as tx

CONFIDENCES = ("certain", "likely", "unsure")
#: Words that refer to another question, or ask for a matching.
REFERENCE = r"(?i)\b(question\s+\d+|q\d+|q\s+\d+|previous\s+question|above\s+question)\b"
MATCHING = r"(?i)\bmatch(?:es|ed|ing)?\b|\bpair(?:s|ed|ing)?\b"


def chunk_violations(planned: DataFrame, worker: DataFrame) -> DataFrame:
    """(run_id, chunk, violation) of chunks whose rows, taken one by one in order, are not the planned ones. Both have run_id, chunk, pos, id."""
    nth = F.row_number().over(Window.partitionBy("run_id", "chunk").orderBy("pos"))
    p = planned.select("run_id", "chunk", nth.alias("n"), F.col("id").alias("want"))
    w = worker.select("run_id", "chunk", nth.alias("n"), F.col("id").alias("got"))
    both = p.join(w, ["run_id", "chunk", "n"], "full_outer").groupBy("run_id", "chunk").agg(F.count("want").alias("wanted"), F.count("got").alias("sent"), F.count_if(F.col("want") != F.col("got")).alias("other"))
    what = F.when(F.col("wanted") != F.col("sent"), "row_count").when(F.col("other") > 0, "id_order")
    return both.withColumn("violation", what).filter("violation is not null").select("run_id", "chunk", "violation")


def solver_chunks(requested: DataFrame, response: DataFrame) -> DataFrame:
    """(run_id, chunk, accepted): one unknown, missing, out-of-range or oddly confident answer rejects its chunk.

    ``requested``: run_id, chunk, id, n_options; ``response``: run_id, chunk, id, idx (null: none), confidence.
    """
    both = requested.withColumn("asked", F.lit(True)).join(response.withColumn("sent", F.lit(True)), ["run_id", "chunk", "id"], "full_outer")
    good = F.col("asked").isNotNull() & F.col("sent").isNotNull() & F.col("confidence").isin(*CONFIDENCES) & (F.col("idx").isNull() | ((F.col("idx") >= 0) & (F.col("idx") < F.col("n_options"))))
    return both.groupBy("run_id", "chunk").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("accepted"))


def assembled(questions: DataFrame, boxes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Questions with their box, the whole page without one, and their evidence, none without. All have run_id and ref."""
    whole = F.struct(F.lit(0.0).alias("ymin"), F.lit(0.0).alias("xmin"), F.lit(1000.0).alias("ymax"), F.lit(1000.0).alias("xmax"))
    return questions.join(boxes, ["run_id", "ref"], "left").join(evidence, ["run_id", "ref"], "left").withColumn("box", F.coalesce("box", whole)).withColumn("evidence", F.coalesce("evidence", F.lit("none")))


def figure_links(figures: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assets, links). Figures (run_id, page, ordinal, refs) with a known row get numbers without gaps; links has a path for each row of a figure."""
    linked = figures.withColumn("ref", F.explode("refs")).join(rows.select("run_id", "ref", "id"), ["run_id", "ref"])
    used = linked.select("run_id", "page", "ordinal").distinct()
    n = F.row_number().over(Window.partitionBy("run_id").orderBy("page", "ordinal"))
    path = F.concat(F.lit("images/asset"), F.lpad(n.cast("string"), 2, "0"), F.lit(".jpg"))
    assets = used.withColumn("path", path)
    return assets, linked.join(assets, ["run_id", "page", "ordinal"]).select("run_id", "id", "path").distinct()


def chunk_assets(assets: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """Assets that a chunk's rows name by path or that link to one of them. ``assets``: run_id, path, linked; ``chunk_rows``: run_id, chunk, id, image_url."""
    by_path = assets.join(chunk_rows.select("run_id", "chunk", F.col("image_url").alias("path")), ["run_id", "path"]).select("run_id", "chunk", "path")
    by_link = assets.withColumn("id", F.explode("linked")).join(chunk_rows.select("run_id", "chunk", "id"), ["run_id", "id"]).select("run_id", "chunk", "path")
    return by_path.unionByName(by_link).distinct()


def boxes_in(requested: DataFrame, answered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted boxes with the question's own page, refs still without one)."""
    accepted = answered.drop("page").join(requested.select("run_id", "ref", "page"), ["run_id", "ref"])
    return accepted, requested.join(answered, ["run_id", "ref"], "left_anti")


def crop_failures(assets: DataFrame, pages: DataFrame, produced: DataFrame) -> DataFrame:
    """(run_id, path, reason): no page, nothing to cut, or no result. ``assets``: run_id, path, page, width, height."""
    a = assets.join(pages.select("run_id", "page", F.lit(True).alias("there")).distinct(), ["run_id", "page"], "left").join(produced.select("run_id", "path", F.lit(True).alias("made")).distinct(), ["run_id", "path"], "left")
    why = F.when(F.col("there").isNull(), "page_missing").when((F.col("width") <= 0) | (F.col("height") <= 0), "empty_box").when(F.col("made").isNull(), "not_produced")
    return a.withColumn("reason", why).filter("reason is not null").select("run_id", "path", "reason")


def ordinal_pairs(letters: DataFrame, questions: DataFrame) -> DataFrame:
    """The n-th letter of a page for its n-th question, only where there are as many of both. Both have run_id, page, pos."""
    by = Window.partitionBy("run_id", "page")
    side = lambda df, name: df.select("run_id", "page", F.row_number().over(by.orderBy("pos")).alias("n"), F.count("*").over(by).alias(f"{name}_all"), F.col(name))
    return side(letters, "letter").join(side(questions, "id"), ["run_id", "page", "n"]).filter("letter_all = id_all").select("run_id", "page", "id", "letter")


def grouped_files(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root): files below the deepest root that holds them. Every folder above a file is looked up, so no pair of all is made."""
    depth = F.size(F.split("path", "/"))
    above = files.withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), depth - 1)))).withColumn("root", F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("k")), "/"))
    return above.join(roots.select("root"), "root").groupBy("path").agg(F.max_by("root", "k").alias("root"))


def key_owners(keys: DataFrame, exams: DataFrame) -> DataFrame:
    """(key, exam): an exam of the key's stem, else its folder's only exam. Both have folder, file, stem."""
    same = keys.alias("k").join(exams.alias("e"), ["folder", "stem"]).groupBy("folder", F.col("k.file").alias("key")).agg(F.min("e.file").alias("by_stem"))
    sole = exams.groupBy("folder").agg(F.count("*").alias("n"), F.min("file").alias("only")).filter("n = 1")
    k = keys.select("folder", F.col("file").alias("key"))
    return k.join(same, ["folder", "key"], "left").join(sole, "folder", "left").select("folder", "key", F.coalesce("by_stem", "only").alias("exam"))


def gates(rows: DataFrame) -> DataFrame:
    """Which runs have a row that refers to another question, or that asks for a matching."""
    t = F.concat_ws(" ", "question", F.array_join("options", " "))
    return rows.groupBy("run_id").agg(F.bool_or(t.rlike(REFERENCE)).alias("refers"), F.bool_or(t.rlike(MATCHING)).alias("matches"))


def united_policy(windows: DataFrame) -> DataFrame:
    """A run's policy from its windows' evidence: none of it says nothing, one kind wins, several are mixed."""
    kinds = F.collect_set(F.when(~F.col("evidence").isin("none", "no_answer_key"), F.col("evidence")))
    one = windows.groupBy("run_id").agg(kinds.alias("kinds"), F.bool_or("has_key").alias("has_key"))
    return one.select("run_id", F.when(F.size("kinds") == 0, "no_answer_key").when(F.size("kinds") == 1, F.element_at("kinds", 1)).otherwise("mixed").alias("policy"), "has_key")


def next_unresolved(rows: DataFrame, open_: Column) -> DataFrame:
    """For each row, the position of the next open row of its run, from the start again behind the last; null without another one."""
    by = Window.partitionBy("run_id").orderBy("pos")
    # From behind, as a frame that ends with the group is gone through anew for each row.
    back = Window.partitionBy("run_id").orderBy(F.desc("pos"))
    later = F.min(F.when(open_, F.col("pos"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    first = F.min(F.when(open_, F.col("pos"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("next_open", F.coalesce(later, first))


def sampled_pages(pages: DataFrame, most: int = 8) -> DataFrame:
    """Every k-th page of a run, ``most`` at the most (a sampling operator)."""
    by = Window.partitionBy("run_id")
    total = F.count("*").over(by)
    step = F.greatest(F.lit(1), F.floor(total / F.least(total, F.lit(most))))
    nth = F.row_number().over(by.orderBy("page")) - 1
    return pages.withColumn("step", step).withColumn("nth", nth).filter((F.col("nth") % F.col("step") == 0) & (F.col("nth") / F.col("step") < most)).drop("step", "nth")


def retry_delay(c: Column) -> Column:
    """seconds of ``3.5s`` or ``7``; null for anything else."""
    return F.regexp_extract(tx.trim(c), r"^(\d+(?:\.\d+)?)s?$", 1).try_cast("double")


def remapped_index(index: Column, before: Column, after: Column) -> Column:
    """where an answer went when options were edited; null if it is gone."""
    return F.when((index >= 0) & (index < F.size(before)), F.nullif(F.array_position(after, F.get(before, index)), F.lit(0)) - 1)
