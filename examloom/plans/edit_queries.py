"""Queries over edits, exports, grades, and rules that stand alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examloom.functions import text as tx
from examloom.operators import assembly, edits, geometry, store
from examloom.plans.catalogue import Tables, joined, query
from examloom.plans.oracle_relations import squeezed, trim


@query("SELECT run_id, CAST(CASE WHEN count(*) >= 7 THEN 6 ELSE -1 END AS INT) AS \"index\" FROM exam_rows GROUP BY 1", "exam_rows")
def jump_index(t: Tables) -> DataFrame:
    return edits.jump_index(t.v1.withColumnRenamed("pos", "question_number"), 7)


_EDITED = "x AS (SELECT run_id, id AS row_id, CASE doc_id % 4 WHEN 0 THEN 'T' WHEN 1 THEN '' END AS topic, CASE WHEN doc_id % 6 = 0 THEN 'S' END AS subtopic, CASE WHEN run_id LIKE '%3' THEN '2020' END AS year FROM exam_rows WHERE doc_id % 3 = 0)"


def _edits(t: Tables) -> DataFrame:
    return t.v1.filter("doc_id % 3 = 0").selectExpr("run_id", "id as row_id", "case doc_id % 4 when 0 then 'T' when 1 then '' end as topic", "case when doc_id % 6 = 0 then 'S' end as subtopic", "case when run_id like '%3' then '2020' end as year")


@query(f", {_EDITED} SELECT run_id, bool_or(coalesce(topic, '') <> '' OR coalesce(subtopic, '') <> '') AS topics, bool_or(coalesce(year, '') <> '') AS year FROM x GROUP BY 1", "exam_rows")
def columns_set(t: Tables) -> DataFrame:
    return edits.columns_set(_edits(t))


@query(
    f""", {_EDITED}, p AS (SELECT run_id, id AS row_id FROM exam_rows WHERE doc_id % 5 = 0), m AS (SELECT run_id, row_id, CASE WHEN p.row_id IS NOT NULL THEN 'New' ELSE topic END AS topic, CASE WHEN p.row_id IS NOT NULL THEN '' ELSE subtopic END AS subtopic, year FROM x FULL JOIN p USING (run_id, row_id))
    SELECT run_id, row_id, nullif(topic, '') AS topic, nullif(subtopic, '') AS subtopic, year FROM m WHERE coalesce(nullif(topic, ''), nullif(subtopic, ''), year) IS NOT NULL""",
    "exam_rows",
)
def merged_edits(t: Tables) -> DataFrame:
    selected = t.v1.filter("doc_id % 5 = 0").select("run_id", F.col("id").alias("row_id"))
    return edits.merged_edits(_edits(t), edits.bulk_patch(selected, topic=" New ", clear=("subtopic",)))


@query("SELECT export, first || CASE WHEN n > 1 THEN ' +' || CAST(n - 1 AS VARCHAR) || ' more' ELSE '' END || ' set.zip' AS name FROM (SELECT p_size AS export, arg_min(p_name, p_partkey) AS first, count(*) AS n FROM part GROUP BY 1)")
def archive_names(t: Tables) -> DataFrame:
    return edits.archive_name(t.part.select(F.col("p_size").alias("export"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("name")), "set")


@query(
    f""", f AS (SELECT id, question, options, correct_index, {trim("question")} || CASE WHEN doc_id % 4 = 0 THEN '!' ELSE '' END AS nq, doc_id, len(options) AS n FROM exam_rows),
    m AS (SELECT *, doc_id % 2 = 0 AND n > 1 AS turned, CASE WHEN doc_id % 9 = 0 OR n = 0 THEN NULL ELSE 0 END AS choice, CASE WHEN doc_id % 5 = 0 THEN 0 END AS stored, TRY_CAST(correct_index AS INT) AS i FROM f),
    d AS (SELECT *, CASE WHEN choice IS NULL THEN '' WHEN turned AND correct_index <> '' THEN CASE WHEN i < n THEN CAST(n - 1 - i AS VARCHAR) ELSE '' END ELSE correct_index END AS ix FROM m)
    SELECT id, CASE WHEN nq <> question THEN nq END AS new_question, CASE WHEN ix <> correct_index THEN ix END AS new_index,
    CASE WHEN choice IS NULL THEN CASE WHEN stored IS NULL THEN 'keep' ELSE 'clear' END WHEN stored IS NOT NULL THEN 'keep' WHEN ix = '0' THEN 'keep' ELSE '0' END AS resolution, CASE WHEN turned THEN CAST(n - 1 AS INT) END AS new_ai FROM d""",
    "exam_rows",
)
def save_plans(t: Tables) -> DataFrame:
    rows = t.v1
    n = F.size("options")
    places = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    turned = (F.col("doc_id") % 2 == 0) & (n > 1)
    form = F.transform(F.when(turned, F.reverse(places)).otherwise(places), lambda i: F.struct(F.get("options", i).alias("text"), i.alias("was")))
    rows = rows.withColumn("form_question", F.concat(tx.trim(F.col("question")), F.when(F.col("doc_id") % 4 == 0, "!").otherwise(""))).withColumn("form_options", form)
    rows = rows.withColumn("choice", F.when((F.col("doc_id") % 9 != 0) & (n > 0), 0)).withColumn("now_index", F.col("correct_index")).withColumn("stored", F.when(F.col("doc_id") % 5 == 0, 0)).withColumn("ai", F.when(n > 0, 0))
    return edits.save_plan(rows).select("id", "new_question", "new_index", "resolution", "new_ai")


@query(
    f""", p AS (SELECT 'v' || CAST(doc_id % 3 AS VARCHAR) AS variant, doc_id, {squeezed("question")} AS q, TRY_CAST(nullif(correct_index, 'x') AS INT) AS a, image_url FROM exam_rows)
    SELECT variant, count(*) AS matched, count(*) FILTER (doc_id % 5 <> 0) AS text_exact, count(*) AS options_exact, count(*) FILTER (doc_id % 4 <> 0) AS page_exact, count(a) AS gradable, count(*) FILTER (a IS NOT NULL AND doc_id % 6 = 1) AS answer_right,
    count(*) FILTER (a IS NOT NULL AND doc_id % 6 NOT IN (0, 1)) AS answer_wrong, count(*) FILTER (a IS NOT NULL AND doc_id % 6 = 0) AS answer_blank, count(*) FILTER (image_url <> '' AND doc_id % 20 = 0) AS figures_missing,
    CASE WHEN count(a) = 0 THEN 'n/a' ELSE CAST(CAST(floor(100.0 * count(*) FILTER (a IS NOT NULL AND doc_id % 6 = 1) / count(a) + 0.5) AS BIGINT) AS VARCHAR) || '%' END AS right_pct FROM p GROUP BY 1""",
    "exam_rows",
)
def variant_grades(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    answer = F.when(F.col("correct_index").rlike("^[0-9]+$"), F.col("correct_index").try_cast("int"))
    got = F.when(d % 6 == 0, None).when(d % 6 == 1, answer).otherwise(F.coalesce(answer, F.lit(0)) + 1)
    figures = F.when(F.col("image_url") == "", F.array().cast("array<string>")).otherwise(F.array("image_url"))
    pairs = t.v1.select(
        F.concat(F.lit("v"), (d % 3).cast("string")).alias("variant"), F.col("question").alias("ref_question"), F.when(d % 5 == 0, F.concat("question", F.lit("?!"))).otherwise(F.concat(F.lit("  "), "question", F.lit("  "))).alias("got_question"), F.col("options").alias("ref_options"), F.col("options").alias("got_options"),
        F.lit(1).alias("ref_page"), F.when(d % 4 == 0, 2).otherwise(1).alias("got_page"), answer.alias("ref_answer"), got.alias("got_answer"), figures.alias("ref_figures"), F.when(d % 20 == 0, F.array().cast("array<string>")).otherwise(figures).alias("got_figures"),
    )
    return edits.variant_grades(pairs)


@query("SELECT id, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 < len(options) THEN CAST(doc_id % 5 AS VARCHAR) ELSE '' END AS correct_index, needs_review FROM exam_rows", "exam_rows")
def bundle_questions(t: Tables) -> DataFrame:
    rows = t.v1.withColumn("answer_source", F.when(F.col("doc_id") % 3 == 0, "extracted").otherwise("reasoned")).withColumn("answer_index", F.col("doc_id") % 5).withColumn("flag", F.when(F.col("needs_review") != "", F.col("needs_review")))
    return edits.exam_questions(rows).select("id", "correct_index", "needs_review")


@query(
    r"""SELECT id, regexp_matches(trim(q), '(?i)^(case stem:|question:)') AS label, regexp_matches(q, '^\s*\(?[0-9]{1,3}\s*[.)-]') AS number FROM (SELECT id, CASE WHEN doc_id % 6 = 2 THEN 'Question: ' || question ELSE question END AS q FROM exam_rows)""",
    "exam_rows",
)
def question_leaks(t: Tables) -> DataFrame:
    q = F.when(F.col("doc_id") % 6 == 2, F.concat(F.lit("Question: "), "question")).otherwise(F.col("question"))
    return t.v1.select("id", tx.leaks(q).alias("l")).select("id", "l.label", "l.number")


#: One decimal of n thousandths: halves as their nearest double lies, in whole numbers of 2**-52.
_TENTHS = "(n // 100 + CASE WHEN n % 100 > 50 OR (n % 100 = 50 AND CAST(n / 1000.0::DOUBLE * 4503599627370496 AS HUGEINT) * 1000 >= CAST(n AS HUGEINT) * 4503599627370496) THEN 1 ELSE 0 END)"


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || '|' || p_type || '|x|' || p_brand END AS options, CASE WHEN n >= 1000 THEN CAST({_TENTHS} // 10 AS VARCHAR) || '.' || CAST({_TENTHS} % 10 AS VARCHAR) || 'k' ELSE CAST(n AS VARCHAR) END AS shown FROM (SELECT *, p_partkey * 37 AS n FROM part)")
def inline_option_lines(t: Tables) -> DataFrame:
    part = t.part
    line = F.concat(F.lit("A) "), "p_name", F.lit("  B) "), "p_type", F.lit(" C. x (D) "), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(""))
    return part.select("p_partkey", joined(tx.inline_options(line)).alias("options"), tx.short_number(F.col("p_partkey") * 37).alias("shown"))


@query(
    """SELECT event_id, 'Copy ' || strftime(ts, '%Y-%m-%d %H%M') || CASE WHEN event_id % 2 = 0 THEN ' full' ELSE '' END || '.bak' AS name, event_id % 3 = 0 OR event_id % 5 = 0 OR event_id % 24 >= 12 AS due FROM events"""
)
def backup_times(t: Tables) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    last = F.when(F.col("event_id") % 5 != 0, at - F.make_interval(hours=(F.col("event_id") % 24).cast("int")))
    reason = F.when(F.col("event_id") % 3 == 0, "batch-finished").otherwise("startup")
    return t.events.select("event_id", tx.backup_name(at, "Copy", F.col("event_id") % 2 == 0, ".bak").alias("name"), tx.backup_due(reason, last, at).alias("due"))


@query(
    """SELECT row_id, CAST(floor(px0 / 1000 * 1654 + 0.5) AS BIGINT) AS "left", CAST(floor(py0 / 1000 * 2339 + 0.5) AS BIGINT) AS top, CAST(greatest(1, least(1654 - floor(px0 / 1000 * 1654 + 0.5), floor((px1 - px0) / 1000 * 1654 + 0.5))) AS BIGINT) AS width,
    CAST(greatest(1, least(2339 - floor(py0 / 1000 * 2339 + 0.5), floor((py1 - py0) / 1000 * 2339 + 0.5))) AS BIGINT) AS height FROM geo""",
    "geo",
)
def rounded_crops(t: Tables) -> DataFrame:
    return t.geo.select("row_id", geometry.rounded_crop(F.col("py0"), F.col("px0"), F.col("py1"), F.col("px1"), 1654, 2339).alias("c")).select("row_id", "c.left", "c.top", "c.width", "c.height")


@query("SELECT row_id, greatest(0, least(py0, oy0) - 25) AS y0, greatest(0, least(px0, ox0) - 25) AS x0, least(1000, greatest(py1, oy1) + 25) AS y1, least(1000, greatest(px1, ox1) + 25) AS x1 FROM geo", "geo")
def answer_focus(t: Tables) -> DataFrame:
    return geometry.answer_focus(t.geo).drop("run_id")


@query(
    r"""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '_', 'g') AS log_name, p_name || '.jpg' AS jpeg, 'img/' || p_name AS path,
    CAST(p_partkey AS VARCHAR) AS parent, p_size % 10 > 4 OR (p_size % 10 = 4 AND p_size % 3 > 1) AS newer, CASE WHEN p_partkey % 2 = 0 THEN 'page-' || CAST(p_size AS VARCHAR) ELSE lower(p_type) END AS section FROM part"""
)
def file_and_key_names(t: Tables) -> DataFrame:
    name = F.concat("p_name", F.lit(" "), "p_brand")
    k = F.col("p_partkey").cast("string")
    version = F.concat_ws(".", (F.col("p_size") % 10).cast("string"), (F.col("p_size") % 3).cast("string"))
    hint = F.when(F.col("p_partkey") % 2 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_type"))
    return t.part.select(
        "p_partkey", tx.file_slug(name).alias("slug"), tx.log_name(name).alias("log_name"), tx.jpeg_path(F.concat("p_name", F.lit(".PNG"))).alias("jpeg"), tx.bundle_path(F.concat(F.lit(".\\img\\"), "p_name")).alias("path"),
        tx.parent_row(F.concat(k, F.when(F.col("p_partkey") % 3 == 0, "~m12").otherwise(""))).alias("parent"), tx.is_newer(version, F.lit("4.1")).alias("newer"), tx.section_key(hint, F.col("p_size")).alias("section"),
    )


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '… [truncated]' ELSE text END AS detail FROM documents")
def detail_lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.truncated(F.col("text"), 300).alias("detail"))


@query("SELECT ref, run_id, CASE WHEN pos % 3 = 0 THEN 0.0::DOUBLE ELSE CAST(page AS DOUBLE) END AS ymin, CASE WHEN pos % 4 = 0 THEN 'inline' ELSE 'none' END AS evidence FROM obs WHERE is_core", "obs")
def assembled_questions(t: Tables) -> DataFrame:
    q = t.seen.filter("is_core").select("run_id", "ref", "pos", "page")
    number = lambda v: F.lit(v).cast("double")
    boxes = q.filter("pos % 3 <> 0").select("run_id", "ref", F.struct(F.col("page").cast("double").alias("ymin"), number(1).alias("xmin"), number(2).alias("ymax"), number(3).alias("xmax")).alias("box"))
    return assembly.assembled(q, boxes, q.filter("pos % 4 = 0").select("run_id", "ref", F.lit("inline").alias("evidence"))).select("ref", "run_id", "box.ymin", "evidence")


@query("SELECT run_id, ref FROM obs WHERE is_core AND pos % 3 = 0", "obs")
def missing_boxes(t: Tables) -> DataFrame:
    q = t.seen.filter("is_core").select("run_id", "ref", "page", "pos")
    return assembly.boxes_in(q, q.filter("pos % 3 <> 0").select("run_id", "ref", F.lit(0).alias("page")))[1].select("run_id", "ref")


@query("SELECT run_id, page, count(*) AS n FROM obs WHERE is_core AND pos % 3 <> 0 GROUP BY 1, 2", "obs")
def accepted_boxes(t: Tables) -> DataFrame:
    q = t.seen.filter("is_core").select("run_id", "ref", "page", "pos")
    unknown = q.filter("pos % 3 = 0").select("run_id", F.concat(F.lit("?"), "ref").alias("ref"), F.lit(0).alias("page"))
    got = assembly.boxes_in(q, q.filter("pos % 3 <> 0").select("run_id", "ref", F.lit(0).alias("page")).unionByName(unknown))[0]
    return got.groupBy("run_id", "page").agg(F.count("*").alias("n"))


@query(", f AS (SELECT run_id, image_url AS path, page, doc_id FROM planned WHERE image_url <> '') SELECT run_id, path, CASE WHEN page % 3 = 0 THEN 'page_missing' WHEN doc_id % 30 = 0 THEN 'empty_box' ELSE 'not_produced' END AS reason FROM f WHERE page % 3 = 0 OR doc_id % 30 = 0 OR doc_id % 20 <> 0", "planned")
def crop_failures(t: Tables) -> DataFrame:
    f = t.v2.filter("image_url <> ''").select("run_id", F.col("image_url").alias("path"), "page", "doc_id", F.when(F.col("doc_id") % 30 == 0, 0).otherwise(9).alias("width"), F.lit(9).alias("height"))
    return assembly.crop_failures(f, t.v2.filter("page % 3 <> 0"), f.filter("doc_id % 20 = 0"))


@query(", f AS (SELECT run_id, pos // 10 AS chunk, image_url AS path FROM exam_rows WHERE image_url <> '') SELECT DISTINCT run_id, CAST(chunk AS INT) AS chunk, path FROM f", "exam_rows")
def chunk_assets(t: Tables) -> DataFrame:
    rows = t.v1.withColumn("chunk", F.expr("cast(pos div 10 as int)"))
    f = rows.filter("image_url <> ''").groupBy("run_id", F.col("image_url").alias("path")).agg(F.collect_list("id").alias("linked"))
    return assembly.chunk_assets(f, rows.select("run_id", "chunk", "id", F.when(F.col("doc_id") % 20 == 0, "").otherwise(F.col("image_url")).alias("image_url")))


@query(
    """WITH f AS (SELECT 'r/' || p_brand || '/' || CAST(p_size % 4 AS VARCHAR) || '/' || CAST(p_partkey AS VARCHAR) AS path, p_brand, p_size FROM part)
    SELECT path, CASE WHEN p_size % 4 = 0 THEN 'r/' || p_brand || '/0' ELSE 'r/' || p_brand END AS root FROM f"""
)
def files_by_root(t: Tables) -> DataFrame:
    b = F.concat(F.lit("r/"), "p_brand")
    files = t.part.select(F.concat_ws("/", b, (F.col("p_size") % 4).cast("string"), F.col("p_partkey").cast("string")).alias("path"))
    roots = t.part.select(b.alias("root")).unionByName(t.part.select(F.concat(b, F.lit("/0")).alias("root"))).distinct()
    return assembly.grouped_files(files, roots)


@query(
    """WITH e AS (SELECT s_nationkey AS folder, 'e' || CAST(s_suppkey AS VARCHAR) AS file, 's' || CAST(s_suppkey AS VARCHAR) AS stem FROM supplier), k AS (SELECT s_nationkey AS folder, 'k' || CAST(s_suppkey AS VARCHAR) AS key, 's' || CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE -1 END AS VARCHAR) AS stem FROM supplier),
    n AS (SELECT folder, count(*) AS n, min(file) AS sole FROM e GROUP BY 1) SELECT k.folder, k.key, coalesce(e.file, CASE WHEN n = 1 THEN sole END) AS exam FROM k LEFT JOIN e ON e.folder = k.folder AND e.stem = k.stem LEFT JOIN n ON n.folder = k.folder"""
)
def key_owners(t: Tables) -> DataFrame:
    s = F.col("s_suppkey").cast("string")
    exams = t.supplier.select(F.col("s_nationkey").alias("folder"), F.concat(F.lit("e"), s).alias("file"), F.concat(F.lit("s"), s).alias("stem"))
    keys = t.supplier.select(F.col("s_nationkey").alias("folder"), F.concat(F.lit("k"), s).alias("file"), F.concat(F.lit("s"), F.when(F.col("s_suppkey") % 2 == 0, s).otherwise("-1")).alias("stem"))
    return assembly.key_owners(keys, exams)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'backup' ELSE 'own' END AS side FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def restored_records(t: Tables) -> DataFrame:
    side = lambda k, name: t.customer.filter(F.col("c_custkey") % k == 0).select(F.col("c_custkey").alias("id"), F.lit(name).alias("side"))
    once = store.restored(side(2, "own"), side(3, "backup"), "id")
    return store.restored(once, side(3, "backup"), "id")
