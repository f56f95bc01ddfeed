"""Rules of a plan and of what comes back for it (P17, P19, P21, P22, P31, P35-P37, J37, J41, J48, J49, A6, A10, A15, A20, A21, A28, A30, W4, W17, L1, L2, L5, L8, U3, U5, U7-U10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examloom.functions import text as tx
from examloom.operators import review
from examloom.order import ranked, ranked_within

#: Answer policies that claim evidence on the pages, and those of a key that can't be used.
EVIDENCE_POLICIES = ("separate_key", "inline_marks", "mixed")
NO_KEY = ("uncertain", "no_answer_key")


def split_pages(pages: DataFrame) -> DataFrame:
    """``part`` of each page: exam up to exam_pages, key behind."""
    return pages.withColumn("part", F.when(F.col("page") <= F.col("exam_pages"), "exam").otherwise("key"))


def claims_evidence(policy: Column) -> Column:
    """P19."""
    return policy.isin(*EVIDENCE_POLICIES)


def with_observed_marks(policy: Column, saw_marks: Column) -> Column:
    """Marks that the index saw on the pages outlive a key that says nothing."""
    return F.when(policy.isin(*NO_KEY) & saw_marks, "mixed").otherwise(policy)


def confirmed(original: Column, focused: Column) -> Column:
    """An answer that was read twice alike."""
    return F.when((original != "") & (original == focused), original).otherwise("")


def on_batch_pages(figures: DataFrame, batch: DataFrame) -> DataFrame:
    """Figures on pages that were asked for."""
    return figures.join(batch.select("run_id", "page").distinct(), ["run_id", "page"], "left_semi")


def placeholders(planned: DataFrame, reason: str) -> DataFrame:
    """A blank row for each planned one, with the planner's fields and pictures."""
    blank = {"question": F.lit(""), "options": F.array().cast("array<string>"), "correct_index": F.lit(""), "needs_review": F.lit(reason)}
    return planned.select(*planned.columns, *(v.alias(k) for k, v in blank.items()))


def all_blank(rows: DataFrame, reason: str) -> DataFrame:
    """Every answer blank, for one reason."""
    return rows.withColumn("correct_index", F.lit("")).withColumn("needs_review", F.lit(reason))


def run_counters(rows: DataFrame) -> DataFrame:
    """Rows, flagged ones, answered and pending ones per run; a run of the short workflow is never safe to import."""
    answered = F.col("correct_index") != ""
    return rows.groupBy("run_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("needs_review") != "").alias("flagged"), F.count_if(answered).alias("answered"), F.count_if(~answered).alias("pending"), F.lit(False).alias("safe_to_import"))


def totals(counters: DataFrame) -> DataFrame:
    """Flags and open rows over all runs, and the runs that have some."""
    return counters.agg(F.coalesce(F.sum("flagged"), F.lit(0)).alias("flags"), F.coalesce(F.sum("pending"), F.lit(0)).alias("pending"), F.count_if(F.col("flagged") > 0).alias("flagged_runs"), F.count("*").alias("runs"))


def usage(requests: DataFrame) -> DataFrame:
    """A10: requests and tokens per run; a request without a token count adds none."""
    return requests.groupBy("run_id").agg(F.count("*").alias("requests"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"))


def figure_rows(questions: DataFrame) -> DataFrame:
    """(run_id, figure, linked): which questions (run_id, pos, id, figures) name each figure, in their order."""
    each = questions.select("run_id", "pos", "id", F.explode(F.array_distinct("figures")).alias("figure"))
    return each.groupBy("run_id", "figure").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("linked"))


def figure_hints(figures: DataFrame, batch: DataFrame) -> DataFrame:
    """Figures on a request's pages, with the page's place in the request. ``batch``: run_id, request, page."""
    n = F.row_number().over(Window.partitionBy("run_id", "request").orderBy("page"))
    return figures.join(batch.select("run_id", "request", "page", n.alias("place")), ["run_id", "page"])


def solver_rows(rows: DataFrame, edits: DataFrame, picks: DataFrame) -> DataFrame:
    """Content edits, then picks; neither additions nor deletions."""
    return review.resolved(review.edited(rows, edits), picks)


def previews(figures: DataFrame, crops: DataFrame, pages: DataFrame) -> DataFrame:
    """Where each figure's picture comes from: its stored crop, else its page, else nowhere. Pages are looked up once each."""
    c = crops.select("run_id", "path", F.lit(True).alias("has_crop")).distinct()
    p = pages.select("run_id", "page", F.lit(True).alias("has_page")).distinct()
    f = figures.join(c, ["run_id", "path"], "left").join(p, ["run_id", "page"], "left")
    return f.select("run_id", "path", "page", F.when(F.col("has_crop"), "crop").when(F.col("has_page"), "page").otherwise("none").alias("preview"))


def question_pages(rows: DataFrame) -> DataFrame:
    """Each run's pages with a question, distinct and ascending, and the most questions on one."""
    per = rows.groupBy("run_id", "page").agg(F.count("*").alias("n"))
    return per.groupBy("run_id").agg(F.array_sort(F.collect_list("page")).alias("pages"), F.max("n").alias("most"))


def owned_and_reread(seen: DataFrame) -> DataFrame:
    """Per window and page, how many questions it owns, and whether another window read one of them again."""
    again = seen.groupBy("run_id", "pos").agg(F.count("*").alias("readings"))
    s = seen.join(again, ["run_id", "pos"])
    return s.groupBy("run_id", "win", "page").agg(F.count_if("is_core").alias("owned"), F.bool_or(F.col("readings") > 1).alias("reread"))


def reconcile_counts(seen: DataFrame, kept: DataFrame) -> DataFrame:
    """Emitted, kept and dropped observations per run."""
    k = kept.groupBy("run_id").agg(F.count("*").alias("kept"))
    return seen.groupBy("run_id").agg(F.count("*").alias("emitted")).join(k, "run_id", "left").select("run_id", "emitted", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("emitted") - F.coalesce("kept", F.lit(0))).alias("dropped"))


def ref_order(refs: DataFrame) -> DataFrame:
    """L1: ``place`` by page and by the numbers in ``ref`` (w2q10 comes behind w2q9)."""
    number = lambda k: F.regexp_extract("ref", r"^w(\d+)q(\d+)$", k).try_cast("long")
    placed = ranked_within(refs, "run_id", [F.col("page").asc(), number(1).asc(), number(2).asc()])
    return placed.withColumn("place", F.col("rank").cast("int")).drop("rank")


def commonest_first(values: DataFrame, value: str) -> DataFrame:
    """All values with n and place, the commonest first, equal counts in the order of the values."""
    placed, _ = ranked(values.groupBy(value).agg(F.count("*").alias("n")), [F.desc("n"), F.col(value).asc()])
    return placed.select(value, "n", F.col("rank").cast("int").alias("place"))


def first_errors(violations: DataFrame) -> DataFrame:
    """The first violation of each run and how many there are."""
    return violations.groupBy("run_id").agg(F.min_by("violation", F.struct("pos", "violation")).alias("first"), F.count("*").alias("n"))


def merged_figures(figures: DataFrame) -> DataFrame:
    """Of figures with the same page and refs, the first."""
    key = F.array_join(F.array_sort("refs"), "|")
    order = F.struct("seq", "anchor")
    return figures.withColumn("key", key).groupBy("run_id", "page", "key").agg(F.min("seq").alias("seq"), F.min_by("anchor", order).alias("anchor"), F.count("*").alias("copies"))


def demoted(topics: DataFrame, moves: DataFrame) -> DataFrame:
    """A topic becomes a subtopic of another, which also takes its subtopics, without repeating one. ``topics``: topic, subtopics; ``moves``: topic, target.

    A topic that is itself a target stays.
    """
    busy = moves.select(F.col("target").alias("topic")).distinct()
    m = moves.filter("topic <> target and trim(topic) <> ''").join(busy, "topic", "left_anti")
    named = F.filter(F.transform("subtopics", lambda s: F.trim(s)), lambda s: s != "")
    extra = topics.join(m, "topic").select("target", "topic", F.concat(F.array(F.trim("topic")), named).alias("new"))
    extra = extra.groupBy("target").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("topic", "new"))), lambda x: x["new"])).alias("new"))
    left = topics.join(m.select("topic"), "topic", "left_anti").join(extra.withColumnRenamed("target", "topic"), "topic", "left")
    fresh = F.array_distinct(F.filter("new", lambda s: ~F.array_contains(F.transform("subtopics", lambda o: F.trim(o)), s)))
    return left.select("topic", F.when(F.col("new").isNull(), F.col("subtopics")).otherwise(F.concat("subtopics", fresh)).alias("subtopics"))


def deletion_set(deleted: DataFrame, added: DataFrame, undone: DataFrame) -> DataFrame:
    """Deletions (run_id, row_id) with more of them, and without those taken back."""
    return deleted.unionByName(added).distinct().join(undone, ["run_id", "row_id"], "left_anti")


def image_paths(rows: DataFrame) -> DataFrame:
    """A run's distinct pictures, in order."""
    return rows.filter("image_url <> ''").groupBy("run_id").agg(F.array_sort(F.collect_set("image_url")).alias("images"))


def stitched_ids(rows: DataFrame) -> DataFrame:
    """Printed ids where they are distinct and not blank in all of a run's windows, else numbers in their order. ``rows``: run_id, pos, printed."""
    unique = rows.groupBy("run_id").agg(((F.count_distinct("printed") == F.count("*")) & (F.count_if(F.col("printed") == "") == 0)).alias("keep"))
    placed = ranked_within(rows.select("run_id", "pos", "printed"), "run_id", [F.col("pos").asc()])
    return placed.join(unique, "run_id").select("run_id", "pos", F.when(F.col("keep"), F.col("printed")).otherwise(F.col("rank").cast("string")).alias("id"))


def sequential(labels: Column, style: str) -> Column:
    """Whether labels run from the start of their style: letters from A or a, numbers from 1, numerals from i."""
    n = F.greatest(F.size(labels), F.lit(1))
    if style == "letters":
        first = F.get(labels, F.lit(0))
        same = first.isin("A", "a") & F.forall(F.transform(labels, lambda x, i: (F.length(x) == 1) & (F.ascii(x) == F.ascii(first) + i)), lambda x: x)
    else:
        value = tx.roman_value if style == "romans" else (lambda x: F.when(x.rlike(r"^\d+$"), x.try_cast("int")))
        same = F.transform(labels, value) == F.sequence(F.lit(1), n)
    return F.coalesce(same, F.lit(False)) & (F.size(labels) > 0)


def halved(chunks: DataFrame) -> DataFrame:
    """A failed chunk (run_id, chunk, ids) in two, the first with the odd one; a single row gets a placeholder instead."""
    n, cut = F.size("ids"), F.ceil(F.size("ids") / 2).cast("int")
    both = F.array(F.struct(F.lit(0).alias("half"), F.slice("ids", F.lit(1), cut).alias("ids")), F.struct(F.lit(1).alias("half"), F.slice("ids", cut + 1, F.greatest(n - cut, F.lit(0))).alias("ids")))
    parts = F.when(n > 1, both).otherwise(F.slice(both, 1, 1))
    return chunks.select("run_id", "chunk", (n == 1).alias("placeholder"), F.explode(parts).alias("p")).select("run_id", "chunk", "p.half", "p.ids", "placeholder")


def with_pinned(shown: DataFrame, every: DataFrame, pinned: DataFrame) -> DataFrame:
    """A filtered list with the open row (run_id, id) at its place, though the filter would hide it."""
    return shown.select("run_id", "pos", "id").unionByName(every.select("run_id", "pos", "id").join(pinned, ["run_id", "id"], "left_semi")).distinct()
