"""Exam relations derived from general tables, so that operators can run where no exam documents are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POLICIES = ("no_answer_key", "separate_key", "inline_marks", "mixed", "uncertain")
LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(key: Column, *values: str, default: str = "") -> Column:
    out = F.lit(default)
    for i, v in reversed(list(enumerate(values))):
        out = F.when(key == i, v).otherwise(out)
    return out


#: Ids of one range are numbered together.
ID_RANGE = 100_000


def positions(documents: DataFrame) -> DataFrame:
    """(source, doc_id, pos): the place of each id in its source. Ids are unique; their texts stay out of it, and a source of any size is numbered by ranges of ids."""
    ids = documents.select("source", "doc_id", F.expr(f"doc_id div {ID_RANGE}").alias("span"))
    sizes = ids.groupBy("source", "span").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("source", "span", before.alias("before"))
    inner = F.row_number().over(Window.partitionBy("source", "span").orderBy("doc_id"))
    return ids.withColumn("inner", inner).join(sizes, ["source", "span"]).select("source", "doc_id", (F.col("inner") + F.col("before")).cast("int").alias("pos"))


def exam_rows(documents: DataFrame) -> DataFrame:
    """V1, of whole texts (the words that are no option are the question): run_id, pos, doc_id, id, question, options, correct_index, needs_review, year, image_url."""
    d, pos = F.col("doc_id"), F.col("pos").cast("string")
    w = F.split("text", " ")
    rows = documents.select("source", "doc_id", "text").join(positions(documents), ["source", "doc_id"])
    n = (d % 6).cast("int")
    prefix = F.when(d % 4 == 0, F.concat(pos, F.lit(". "))).when(d % 4 == 1, F.concat(F.lit("Q"), pos, F.lit(") "))).otherwise("")
    return rows.select(
        F.col("source").alias("run_id"),
        "pos",
        "doc_id",
        d.cast("string").alias("id"),
        F.concat(prefix, F.array_join(F.concat(F.slice(w, 1, 12), F.slice(w, n + 13, F.greatest(F.lit(0), F.size(w) - n - 12))), " ")).alias("question"),
        F.slice(w, F.lit(13), n).alias("options"),
        F.when(d % 7 == 0, "").when(d % 11 == 0, "x").otherwise((d % 5).cast("string")).alias("correct_index"),
        pick(d % 13, "no_answer_key", "conflicting_marks", "options_cut_at_page_break", "key_unclear", "not_mcq").alias("needs_review"),
        F.when(d % 3 == 0, "2024").otherwise("").alias("year"),
        F.when(d % 10 == 0, F.concat(F.lit("images/asset"), F.lpad(pos, 2, "0"), F.lit(".png"))).otherwise("").alias("image_url"),
    )


def labelled_options(rows: DataFrame) -> DataFrame:
    """V1 with a label before each option."""
    styles = ("concat(chr(65 + i), '. ', o)", "concat('(', chr(97 + i), ') ', o)", "concat(string(i + 1), '. ', o)", "concat(element_at(array('i', 'ii', 'iii', 'iv', 'v'), i + 1), '. ', o)")
    cases = " ".join(f"when {k} then {s}" for k, s in enumerate(styles))
    return rows.withColumn("options", F.expr(f"transform(options, (o, i) -> case doc_id % 5 {cases} else o end)"))


def planned_rows(rows: DataFrame) -> DataFrame:
    """V2: the planner's side of V1: run_id, pos, doc_id, id, policy, reason, page, page_count, image_url."""
    number = F.regexp_extract("run_id", r"(\d+)$", 1).cast("int")
    page = F.floor(F.col("pos") / 5).cast("int") + 1
    planned = rows.filter(F.col("doc_id") % 19 != 0).select(
        "run_id",
        "pos",
        "doc_id",
        "id",
        pick(number % 5, *POLICIES).alias("policy"),
        F.when(F.col("needs_review").isin("conflicting_marks", "key_unclear"), F.col("needs_review")).otherwise("").alias("reason"),
        page.alias("page"),
        "image_url",
    )
    return planned.join(planned.groupBy("run_id").agg(F.max("page").alias("page_count")), "run_id")


def resolutions(labels: DataFrame) -> DataFrame:
    """V3: (doc_id, pick)."""
    return labels.groupBy("doc_id").agg(F.max(F.col("quality") + 2 * F.col("toxic")).alias("pick"))


def edits(benchmark: DataFrame) -> DataFrame:
    """V3: (doc_id, new_question, new_topic); a null field isn't edited."""
    return benchmark.select(F.col("item_id").alias("doc_id"), F.col("text").alias("new_question"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("T"), (F.col("item_id") % 3).cast("string"))).alias("new_topic"))


def deletions(labels: DataFrame) -> DataFrame:
    return labels.filter("toxic = 1 and doc_id % 2 = 0").select("doc_id").distinct()


def additions(conversations: DataFrame) -> DataFrame:
    """V3: blank rows, dealt to runs by conversation."""
    c = conversations.filter("turn = 0")
    return c.select(F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("run_id"), F.concat(F.lit("added-"), F.col("conv_id").cast("string")).alias("id"))


def ai_answers(labels: DataFrame) -> DataFrame:
    """V3: (doc_id, ai, confidence)."""
    one = labels.filter("doc_id % 3 = 0").groupBy("doc_id").agg(F.max(F.col("quality") + F.col("toxic")).alias("ai"))
    return one.select("doc_id", "ai", pick(F.col("doc_id") % 4, "certain", "likely", default="unsure").alias("confidence"))


def topics(region: DataFrame, nation: DataFrame) -> DataFrame:
    """V4: (topic, subtopic)."""
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("r_name").alias("topic"), F.col("n_name").alias("subtopic"))


def topic_picks(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """V4: (row_id, topic, subtopic), some of them wrong."""
    n, r = nation, region
    s = supplier.join(n, supplier["s_nationkey"] == n["n_nationkey"])
    key = F.when(F.col("s_suppkey") % 10 == 0, (F.col("n_regionkey") + 1) % 5).otherwise(F.col("n_regionkey"))
    s = s.withColumn("rk", key).join(r, F.col("rk") == r["r_regionkey"])
    m = F.col("s_suppkey") % 10
    topic = F.when(m.isin(1, 2), "").when(m == 3, "NOWHERE").otherwise(F.col("r_name"))
    return s.select(F.col("s_suppkey").alias("row_id"), topic.alias("topic"), F.when(m == 2, "").otherwise(F.col("n_name")).alias("subtopic"))


def continuations(conversations: DataFrame) -> DataFrame:
    """V5: run_id, pos, page, continuation, options."""
    w = F.split("text", " ")
    return conversations.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("pos"), F.col("turn").alias("page"), (F.col("role") != "user").alias("continuation"), F.slice(w, F.lit(1), (F.col("turn") % 4 + 1).cast("int")).alias("options"))


def chained_continuations(conversations: DataFrame) -> DataFrame:
    """V5 with two rows on a page, continuations of continuations, answers and reasons: run_id, pos, page, continuation, options, correct_index, needs_review."""
    turn = F.col("turn")
    rows = continuations(conversations.withColumn("role", F.when((turn + F.col("conv_id")) % 4 == 0, "user").otherwise("other")))
    answer = F.when(F.col("pos") % 3 == 0, "").otherwise((F.col("pos") % (F.col("pos") % 4 + 1)).cast("string"))
    reason = pick(F.col("pos") % 5, "no_visible_answer", "", "key_unclear", "options_cut_at_page_break", default="incomplete_options")
    return rows.withColumn("page", F.floor(F.col("pos") / 2)).withColumn("correct_index", answer).withColumn("needs_review", reason)


def log_events(events: DataFrame) -> DataFrame:
    """V6: seq, t, event, level, run_id, ms, k, model."""
    k = F.expr("try_cast(get_json_object(props, '$.k') as bigint)")
    e = events.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("t"), F.col("event_type").alias("event"), F.col("user_id").alias("run_id"), F.col("value").alias("ms"), k.alias("k"), "props")
    level = F.when(F.col("event") == "error", "error").when(F.col("event") == "signup", "warn").otherwise("info")
    return e.withColumn("level", level).withColumn("model", F.when(F.col("k") % 2 == 0, "even").otherwise("odd"))


def observations(rows: DataFrame) -> DataFrame:
    """run_id, win, ordinal, is_core, page, label, anchor, ref; rows with ordinal 0 are seen by the window before, too."""
    base = rows.select(
        "run_id", "pos", F.floor(F.col("pos") / 10).cast("int").alias("win"), (F.col("pos") % 10).cast("int").alias("ordinal"),
        (F.floor(F.col("pos") / 3) + 1).cast("int").alias("page"),
        F.when(F.col("pos") % 7 == 0, "").otherwise((F.col("pos") % 7).cast("string")).alias("label"),
        F.array_join(F.slice(F.split("question", " "), 1, 6), " ").alias("anchor"),
    )
    own = base.withColumn("is_core", F.lit(True))
    seen = base.filter("ordinal = 0 and win > 0").withColumn("win", F.col("win") - 1).withColumn("ordinal", F.lit(10)).withColumn("is_core", F.lit(False))
    return own.unionByName(seen).withColumn("ref", F.concat(F.lit("w"), F.col("win").cast("string"), F.lit("q"), F.col("ordinal").cast("string")))


def artifacts(lineitem: DataFrame) -> DataFrame:
    """V7: run_id, kind, created_at, path, seq (the tie-break)."""
    path = F.concat_ws("/", *(F.col(c).cast("string") for c in LINE))
    order = F.struct(*LINE)
    return lineitem.select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("kind"), F.col("l_shipdate").alias("created_at"), path.alias("path"), order.alias("seq"))


def runs(orders: DataFrame) -> DataFrame:
    """V7: run_id, job_id, status, created_at."""
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("paused")
    return orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("job_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


def run_pages(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """V7: runs with page_count and pages_rendered."""
    counted = lineitem.groupBy("l_orderkey").agg(F.count("*").alias("page_count"), F.count_if(F.col("l_linestatus") == "F").alias("pages_rendered"))
    out = runs(orders).join(counted, F.col("run_id") == F.col("l_orderkey"), "left").drop("l_orderkey")
    return out.fillna(0, ["page_count", "pages_rendered"])


def file_names(part: DataFrame) -> DataFrame:
    """(seq, file_name), with collisions in all but case."""
    name = F.concat(F.col("p_name"), F.lit(" (v"), (F.col("p_size") % 3).cast("string"), F.lit(").PDF"))
    return part.select(F.col("p_partkey").alias("seq"), F.when(F.col("p_partkey") % 2 == 0, F.upper(name)).otherwise(name).alias("file_name"))


def geometry(lineitem: DataFrame) -> DataFrame:
    """V8: run_id, page, row_id, prompt box (p*) and options box (o*)."""
    row = F.concat_ws("/", *(F.col(c).cast("string") for c in LINE))
    g = lineitem.select(
        F.floor(F.col("l_orderkey") / 64).alias("run_id"), (F.col("l_orderkey") % 4 + 1).cast("int").alias("page"), row.alias("row_id"),
        ((F.col("l_partkey") * 7) % 900).cast("double").alias("py0"), ((F.col("l_suppkey") * 13) % 2 * 500).cast("double").alias("px0"), F.col("l_quantity").alias("q"),
    )
    g = g.withColumn("py1", F.col("py0") + 20).withColumn("px1", F.col("px0") + 450)
    return g.select("run_id", "page", "row_id", "py0", "px0", "py1", "px1", F.col("py1").alias("oy0"), F.col("px0").alias("ox0"), (F.col("py1") + F.col("q")).alias("oy1"), F.col("px1").alias("ox1"))
