"""Continuations and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examloom.functions import text as tx
from examloom.order import ranked_within, with_previous
from examloom.rounds import jumped
from examloom.storage import materialize

#: Reasons that a continuation may remove.
PASSING_REASONS = ("empty_question", "incomplete_options", "no_visible_answer", "options_cut_at_page_break")


def prior_stems(rows: DataFrame) -> DataFrame:
    """W3, one hop: each continuation with the last earlier stem on the page before (null: orphan)."""
    c = rows.filter("continuation").select("run_id", "pos", "page", "options")
    s = rows.filter("not continuation").select("run_id", (F.col("page") + 1).alias("page"), F.col("pos").alias("stem"))
    last = c.join(s, ["run_id", "page"], "left").filter("stem is null or stem < pos").groupBy("run_id", "pos").agg(F.max("stem").alias("stem_pos"))
    return c.join(last, ["run_id", "pos"], "left")


def stitched(rows: DataFrame) -> DataFrame:
    """W3, one hop: stems with the options of their continuations behind their own, in order; orphans stay, flagged."""
    c = prior_stems(rows)
    more = c.filter("stem_pos is not null").groupBy("run_id", F.col("stem_pos").alias("pos")).agg(F.sort_array(F.collect_list(F.struct("pos", "options"))).alias("more"))
    stems = rows.filter("not continuation").join(more, ["run_id", "pos"], "left")
    joined = F.when(F.col("more").isNull(), F.col("options")).otherwise(F.concat("options", F.flatten(F.transform("more", lambda m: m["options"]))))
    stems = stems.select("run_id", "pos", joined.alias("options"), F.coalesce(F.size("more"), F.lit(0)).alias("joined"), F.lit("").alias("reason"))
    orphans = c.filter("stem_pos is null").select("run_id", "pos", "options", F.lit(0).alias("joined"), F.lit("orphaned_page_continuation").alias("reason"))
    return stems.unionByName(orphans)


def chained_stems(rows: DataFrame) -> DataFrame:
    """W3 with chains: (run_id, pos, stem_pos) of each continuation (null: orphan). A stem also gains the pages of its continuations.

    The stem of a continuation is the later of the last stem on the page before, and the stem of the last continuation there, which is the latest of
    all that any continuation there has. So each continuation points to that one, and the chains are followed by doubling.
    """
    page = Window.partitionBy("run_id", "page").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.select("run_id", "pos", "page", F.when(~F.col("continuation"), F.col("pos")).alias("stem"), F.when(F.col("continuation"), F.col("pos")).alias("more"), F.lit(False).alias("asks"))
    asks = rows.filter("continuation").select("run_id", "pos", (F.col("page") - 1).alias("page"), F.lit(None).cast("long").alias("stem"), F.lit(None).cast("long").alias("more"), F.lit(True).alias("asks"))
    near = own.unionByName(asks).select("run_id", "pos", "asks", F.last("stem", True).over(page).alias("value"), F.last("more", True).over(page).alias("more")).filter("asks")
    node = lambda pos: F.struct("run_id", F.col(pos).alias("pos"))
    links = near.select(node("pos").alias("node"), F.when(F.col("more").isNotNull(), node("more")).alias("next"), "value")
    return jumped(links, F.greatest).select("node.*", F.col("value").alias("stem_pos"))


def _joined_up(stem: Column, more: Column) -> Column:
    """Options, answer and reason of a stem after each of its continuations in turn."""

    def add(a: Column, m: Column) -> Column:
        shifted = F.when(m["correct_index"] == "", "").otherwise((F.size(a["options"]) + m["correct_index"].try_cast("int")).cast("string"))
        answer = F.when(a["correct_index"] != "", a["correct_index"]).otherwise(F.coalesce(shifted, F.lit("")))
        stays = [~r.isin(*PASSING_REASONS) for r in (a["needs_review"], m["needs_review"])]
        reason = F.when(stays[0], a["needs_review"]).when(stays[1], m["needs_review"]).when(answer == "", "no_visible_answer").otherwise("")
        return F.struct(F.concat(a["options"], m["options"]).alias("options"), answer.alias("correct_index"), reason.alias("needs_review"))

    return F.aggregate(more, stem, add)


def stitched_rows(rows: DataFrame) -> DataFrame:
    """W3 with chains, answers and reasons, of (run_id, pos, page, continuation, options, correct_index, needs_review): stems with what their continuations
    add, and orphans. An answer of a continuation counts from the options before it; the first one stays.

    A stem's continuations meet in one value, as its options do in the result.
    """
    content = ("options", "correct_index", "needs_review")
    c = rows.filter("continuation").join(chained_stems(rows), ["run_id", "pos"])
    more = c.filter("stem_pos is not null").groupBy("run_id", F.col("stem_pos").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("pos", *content))).alias("more"))
    stems = rows.filter("not continuation").join(more, ["run_id", "pos"], "left").withColumn("s", _joined_up(F.struct(*content), F.coalesce("more", F.array().cast(more.schema["more"].dataType))))
    stems = stems.select("run_id", "pos", "s.*", F.coalesce(F.size("more"), F.lit(0)).alias("joined"))
    orphan = F.when(F.col("needs_review") == "", "orphaned_page_continuation").otherwise(F.col("needs_review"))
    return stems.unionByName(c.filter("stem_pos is null").select("run_id", "pos", "options", "correct_index", orphan.alias("needs_review"), F.lit(0).alias("joined")))


def stitched_exactly(rows: DataFrame) -> DataFrame:
    """W3 with chains, options only: (run_id, pos, options, joined, reason)."""
    bare = rows.select("run_id", "pos", "page", "continuation", "options", F.lit("").alias("correct_index"), F.lit("").alias("needs_review"))
    return stitched_rows(bare).select("run_id", "pos", "options", "joined", F.when(F.col("needs_review") == "orphaned_page_continuation", F.col("needs_review")).otherwise("").alias("reason"))


def score(question: Column, options: Column, answer: Column) -> Column:
    """Length, and an answer before anything else."""
    return F.length(question) + F.length(F.array_join(options, "")) + F.when(answer == "", 0).otherwise(1_000_000)


def best_of(rows: DataFrame, *key: str) -> DataFrame:
    """W18 for one kind of key: the row with the highest score, the first of equals, and how many it stands for."""
    s = rows.withColumn("score", score(F.col("question"), F.col("options"), F.col("correct_index")))
    best = F.max_by("id", F.struct("score", -F.col("pos")))
    return s.groupBy(*key).agg(best.alias("id"), F.max("score").alias("score"), F.count("*").alias("copies"))


def deduped(rows: DataFrame) -> DataFrame:
    """(run_id, pos, id, score): of all rows of one key the one with the highest score, the first of equals.

    A row without a label is named by its place in the run. Rows of one label have one key: that of the last row before the label's first one with the
    same content, or else the label itself. So each label points to another that starts earlier, and its key is where that way ends. Contents are
    told to be equal by their SHA-256. Runs may be of any size; a label or content that most rows share is dealt to many tasks.
    """
    content = F.sha2(tx.content_key(F.col("question"), F.col("options")), 256)
    keyed = rows.select("run_id", "pos", F.col("label").alias("printed"), content.alias("content"), score(F.col("question"), F.col("options"), F.col("correct_index")).alias("score"))
    placed = ranked_within(keyed, "run_id", [F.col("pos").asc()])
    name = F.when(F.coalesce("printed", F.lit("")) == "", F.concat(F.lit("row-"), F.col("rank").cast("string"))).otherwise(F.col("printed"))
    named = materialize(placed.select("run_id", "pos", name.alias("label"), "content", "score"))
    first = named.groupBy("run_id", "label").agg(F.min("pos").alias("pos"))
    before = with_previous(named, [F.col("run_id").asc(), F.col("content").asc(), F.col("pos").asc()], ["run_id", "content", "label"])
    alike = (F.col("previous.run_id") == F.col("run_id")) & (F.col("previous.content") == F.col("content"))
    node = lambda label: F.struct("run_id", F.col(label).alias("label"))
    links = before.join(first, ["run_id", "label", "pos"], "left_semi").select(node("label").alias("node"), F.when(alike, node("previous.label")).alias("next"), F.col("label").alias("value"))
    keys = jumped(links).select("node.*", F.col("value").alias("key"))
    best = F.max_by(F.struct("pos", F.col("label").alias("id"), "score"), F.struct("score", -F.col("pos")))
    return named.join(keys, ["run_id", "label"]).groupBy("run_id", "key").agg(best.alias("b")).select("run_id", "b.*")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Question numbers from 1, in order, within a run."""
    return rows.withColumn("question_number", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)))
