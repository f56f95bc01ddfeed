"""Queries over exports with set columns, review lists, folders, tallies and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examloom.operators import edits, narrowing, outcomes, review, topics
from examloom.plans.catalogue import Tables, query

_MODES = "CASE CAST(regexp_extract(run_id, '([0-9]+)$', 1) AS INT) % 4 WHEN 0 THEN 'ai' WHEN 1 THEN 'type' WHEN 2 THEN 'none' END"
_TYPED = "CASE WHEN CAST(regexp_extract(run_id, '([0-9]+)$', 1) AS INT) % 8 = 1 THEN '1999' END"
_EDITED = "CASE WHEN doc_id % 7 = 0 THEN '1987' END"
_QUOTED = "CASE WHEN regexp_matches({0}, '[\",\\r\\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"
_JSON = "'[' || array_to_string(list_transform({0}, lambda o: CAST(to_json(o) AS VARCHAR)), ',') || ']'"


@query(
    f""", f AS (SELECT run_id, {_MODES} AS mode, CASE WHEN {_MODES} = 'type' THEN coalesce({_TYPED}, '') ELSE '' END AS typed, run_id IN ('src1', 'src2', 'src5', 'src11') AS topics, CAST(regexp_extract(run_id, '([0-9]+)$', 1) AS INT) % 3 = 0 AS edits_year FROM (SELECT DISTINCT run_id FROM exam_rows)),
    g AS (SELECT run_id, topics, coalesce(mode = 'ai', false) OR typed <> '' OR edits_year AS years, CASE WHEN typed <> '' THEN typed WHEN NOT coalesce(mode = 'ai', false) AND edits_year THEN '' END AS stamp FROM f),
    r AS (SELECT e.run_id, pos, topics, years, coalesce(CASE WHEN CAST(regexp_extract(e.run_id, '([0-9]+)$', 1) AS INT) % 3 = 0 THEN {_EDITED} END, stamp, year) AS y, 'T,' || id AS topic, 'S' AS subtopic, e.run_id || '.pdf' AS source, question AS q, {_JSON.format("options")} AS o, correct_index AS c, CASE WHEN image_url = '' THEN '[]' ELSE '["' || image_url || '"]' END AS i FROM exam_rows e JOIN g USING (run_id))
    SELECT run_id, CAST(-1 AS BIGINT) AS pos, CASE WHEN topics THEN 'topic,subtopic,' ELSE '' END || CASE WHEN years THEN 'year,' ELSE '' END || 'source,question,options,correct_index,image_url' AS line FROM g
    UNION ALL SELECT run_id, CAST(pos AS BIGINT), CASE WHEN topics THEN {_QUOTED.format("topic")} || ',' || subtopic || ',' ELSE '' END || CASE WHEN years THEN y || ',' ELSE '' END || source || ',' || {_QUOTED.format("q")} || ',' || {_QUOTED.format("o")} || ',' || c || ',' || {_QUOTED.format("i")} FROM r""",
    "exam_rows",
)
def export_set_columns(t: Tables) -> DataFrame:
    rows = t.v1
    number = F.regexp_extract("run_id", r"(\d+)$", 1).cast("int")
    runs = rows.select("run_id").distinct().select("run_id", F.expr(_MODES).alias("year_mode"), F.expr(_TYPED).alias("typed_year"))
    has_edit = number % 3 == 0
    # A run's edits set its year, and in one its topic.
    log = runs.filter(has_edit).select("run_id", F.lit(None).cast("string").alias("topic"), F.lit(None).cast("string").alias("subtopic"), F.lit("1987").alias("year")).unionByName(
        runs.filter("run_id = 'src11'").select("run_id", F.lit("T").alias("topic"), F.lit("").alias("subtopic"), F.lit(None).cast("string").alias("year"))
    )
    flags = outcomes.export_flags(runs, runs.filter("run_id in ('src1', 'src2', 'src5')"), edits.columns_set(log))
    images = F.when(F.col("image_url") == "", F.array().cast("array<string>")).otherwise(F.array("image_url"))
    out = rows.withColumns({"topic": F.concat(F.lit("T,"), "id"), "subtopic": F.lit("S"), "source": F.concat("run_id", F.lit(".pdf")), "image_urls": images, "edited_year": F.when(has_edit, F.expr(_EDITED))})
    return outcomes.export_lines(out, flags)


@query(
    """SELECT id FROM category e LEFT JOIN picks USING (doc_id) WHERE flagged AND NOT coalesce(pick < len(options), false) AND (contains(lower(question), 'th') OR len(list_filter(options, lambda o: contains(lower(o), 'th'))) > 0)""",
    "category", "picks",
)
def review_search(t: Tables) -> DataFrame:
    rows = t.v1.join(t.picks, "doc_id", "left")
    return outcomes.review_list(rows, " TH ", review.is_flagged() & ~F.coalesce(F.col("pick") < F.size("options"), F.lit(False))).select("id")


_ANSWER = """CASE WHEN p_partkey % 13 = 0 THEN '[]' ELSE '{"source":' || CASE p_partkey % 5 WHEN 0 THEN '"extracted"' WHEN 1 THEN '"reasoned"' WHEN 2 THEN '"reasoned"' WHEN 3 THEN '"guess"' ELSE '7' END || ',"index":' || CASE p_partkey % 7 WHEN 0 THEN '2' WHEN 1 THEN '1.0' WHEN 2 THEN '-1' WHEN 3 THEN '1.5' WHEN 4 THEN '"1"' ELSE '0' END
 || CASE p_partkey % 4 WHEN 0 THEN ',"confidence":"certain"' WHEN 1 THEN ',"confidence":"maybe"' WHEN 2 THEN ',"confidence":"unsure"' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN ',"evidence":"page ' || CAST(p_partkey AS STRING) || '"' ELSE '' END || '}' END"""


@query(
    f"""WITH a AS (SELECT p_partkey, p_size % 4 AS n, CAST({_ANSWER} AS JSON) AS v FROM part), b AS (SELECT *, CASE WHEN json_type(v) = 'OBJECT' AND json_type(v, '$.source') = 'VARCHAR' AND v->>'$.source' IN ('extracted', 'reasoned') THEN v->>'$.source' ELSE 'none' END AS source,
        CASE WHEN json_type(v, '$.index') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(v->>'$.index' AS DOUBLE) = floor(CAST(v->>'$.index' AS DOUBLE)) AND CAST(v->>'$.index' AS DOUBLE) >= 0 AND CAST(v->>'$.index' AS DOUBLE) < n THEN CAST(CAST(v->>'$.index' AS DOUBLE) AS INT) END AS i FROM a),
    c AS (SELECT *, source <> 'none' AND i IS NULL AS demoted FROM b)
    SELECT p_partkey, CASE WHEN demoted THEN 'none' ELSE source END AS source, i AS "index", CASE WHEN source = 'reasoned' AND NOT demoted THEN CASE WHEN v->>'$.confidence' IN ('certain', 'unsure') THEN v->>'$.confidence' ELSE 'likely' END END AS confidence,
        CASE WHEN source <> 'none' AND NOT demoted THEN v->>'$.evidence' END AS evidence, demoted FROM c"""
)
def narrowed_answers(t: Tables) -> DataFrame:
    rows = narrowing.read_responses(t.part.select("p_partkey", F.expr(_ANSWER).alias("text"), F.expr("slice(array('a', 'b', 'c'), 1, p_size % 4)").alias("options")))
    return rows.select("p_partkey", outcomes.narrowed_answer(F.col("value"), F.col("options")).alias("a")).select("p_partkey", "a.*")


@query(
    """SELECT run_id, count(*) AS questions, count(*) FILTER (correct_index <> '') AS extracted, count(*) FILTER (ai.doc_id IS NOT NULL) AS awaiting, count(*) FILTER (correct_index = '' OR needs_review <> '') AS flagged FROM exam_rows LEFT JOIN ai USING (doc_id) GROUP BY run_id""",
    "exam_rows", "ai",
)
def import_summaries(t: Tables) -> DataFrame:
    return outcomes.import_summary(t.v1.join(t.ai.select("doc_id", F.lit(True).alias("there")), "doc_id", "left").withColumn("awaiting", F.coalesce("there", F.lit(False))))


def _jobs(t: Tables) -> DataFrame:
    """Customers as jobs; those of one market segment are folders, and a tenth is lost."""
    return t.customer.filter("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("job_id"), F.when(F.col("c_mktsegment") == "BUILDING", "folder").otherwise("job").alias("kind"), F.col("c_name").alias("name"))


_JOBS = "jobs AS (SELECT c_custkey AS job_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'folder' ELSE 'job' END AS kind, c_name AS name FROM customer WHERE c_custkey % 10 <> 3)"


@query(
    f""", {_JOBS}, r AS (SELECT run_id, job_id, j.job_id IS NOT NULL AS ok FROM runs LEFT JOIN (SELECT job_id FROM jobs) j USING (job_id)), a AS (SELECT g.run_id IS NOT NULL AS ok FROM lineitem LEFT JOIN (SELECT run_id FROM r WHERE job_id IN (SELECT job_id FROM jobs)) g ON g.run_id = l_orderkey),
    f AS (SELECT j.job_id IS NOT NULL AS ok FROM supplier LEFT JOIN jobs j ON j.job_id = s_suppkey)
    SELECT (SELECT count(*) FROM jobs WHERE kind = 'folder') AS folders, (SELECT count(*) FROM runs WHERE job_id IN (SELECT job_id FROM jobs)) AS runs, (SELECT count(*) FROM a WHERE ok) AS artifacts, (SELECT count(*) FROM f WHERE ok) AS files,
    (SELECT count(*) FROM runs WHERE job_id NOT IN (SELECT job_id FROM jobs)) + (SELECT count(*) FROM a WHERE NOT ok) + (SELECT count(*) FROM f WHERE NOT ok) AS skipped""",
    "runs",
)
def restored_outcome(t: Tables) -> DataFrame:
    return outcomes.restore_outcome(_jobs(t), t.runs, t.lineitem.select(F.col("l_orderkey").alias("run_id")), t.supplier.select(F.col("s_suppkey").alias("job_id")))


@query(
    """, m AS (SELECT job_id, run_id, run_id % 5 <> 0 AS matches, CASE WHEN run_id % 7 = 0 THEN 'quota ' || CAST(run_id % 3 AS VARCHAR) END AS reason FROM runs WHERE status = 'done')
    SELECT job_id, count(*) FILTER (matches AND reason IS NULL) AS matched, count(*) FILTER (matches) AS total, arg_min(reason, run_id) FILTER (matches AND reason IS NOT NULL) AS failure FROM m GROUP BY 1""",
    "runs",
)
def folder_matches(t: Tables) -> DataFrame:
    from examloom.operators import store

    runs = t.runs.withColumn("excluded", F.when(F.col("run_id") % 5 == 0, True))
    failures = runs.filter("run_id % 7 = 0").select("run_id", F.concat(F.lit("quota "), (F.col("run_id") % 3).cast("string")).alias("reason"))
    return outcomes.folder_outcomes(store.matching_targets(runs), failures)


@query(
    """, d AS (SELECT DISTINCT run_id, 'job' || CAST(CAST(regexp_extract(run_id, '([0-9]+)$', 1) AS INT) % 6 AS VARCHAR) AS job_id, CAST(regexp_extract(run_id, '([0-9]+)$', 1) AS INT) % 3 <> 0 AS done, CAST(regexp_extract(run_id, '([0-9]+)$', 1) AS INT) % 4 <> 0 AS listed FROM exam_rows),
    p AS (SELECT run_id, count(*) AS n FROM exam_rows ANTI JOIN matched USING (doc_id) GROUP BY 1) SELECT job_id, CAST(coalesce(sum(n) FILTER (done AND listed), 0) AS BIGINT) AS pending FROM d LEFT JOIN p USING (run_id) GROUP BY 1""",
    "exam_rows", "matched",
)
def pending_topic_totals(t: Tables) -> DataFrame:
    number = F.regexp_extract("run_id", r"(\d+)$", 1).cast("int")
    pending = topics.pending(t.v1, t.matched).groupBy("run_id").agg(F.count("*").alias("pending"))
    runs = t.v1.select("run_id").distinct().select("run_id", F.concat(F.lit("job"), (number % 6).cast("string")).alias("job_id"), F.when(number % 3 != 0, "done").otherwise("paused").alias("status"))
    return outcomes.pending_topics(runs, runs.filter(number % 4 != 0), pending)


@query(f""", {_JOBS} SELECT count(*) FILTER (kind = 'folder') AS folders, (SELECT count(*) FROM runs) AS runs, count(*) FILTER (kind = 'folder') > 0 OR (SELECT count(*) FROM runs WHERE job_id <> 1) > 0 AS backable FROM jobs""", "runs")
def backup_contents(t: Tables) -> DataFrame:
    return outcomes.backup_contents(_jobs(t), t.runs, 1)


@query(
    """SELECT s_suppkey AS job_id, CASE WHEN s_suppkey % 6 = 0 THEN 'New ' || CAST(s_suppkey AS VARCHAR) WHEN s_suppkey % 4 = 0 THEN 'Untitled folder' ELSE s_name END AS name, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 2 = 0 ELSE s_suppkey % 5 = 0 END AS excluded FROM supplier"""
)
def folders_kept(t: Tables) -> DataFrame:
    s = t.supplier.select(F.col("s_suppkey").alias("job_id"), F.when(F.col("s_suppkey") % 4 == 0, " \t").otherwise(F.concat(F.lit(" "), "s_name", F.lit(" "))).alias("name"))
    i = F.col("job_id")
    named = outcomes.renamed_folders(outcomes.created_folders(s), s.filter(i % 2 == 0).select("job_id", F.when(i % 3 == 0, F.concat(F.lit("New "), i.cast("string"), F.lit("  "))).otherwise(" ").alias("new_name")))
    runs = s.select(i.alias("run_id"), (i % 5 == 0).alias("excluded"))
    flagged = outcomes.with_exclusions(runs, runs.filter("run_id % 3 = 0").select("run_id", (F.col("run_id") % 2 == 0).alias("new_excluded")))
    return named.join(flagged.withColumnRenamed("run_id", "job_id"), "job_id").select("job_id", "name", "excluded")


@query(
    """, e AS (SELECT run_id AS key, CAST(t AS DATE) AS day, CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END AS model, seq % 3 = 0 AS old FROM log), z AS (SELECT DISTINCT run_id AS key, CAST(t AS DATE) AS day FROM log WHERE event = 'signup' AND seq % 5 = 0),
    l AS (SELECT key, max(day) AS last FROM (SELECT key, day FROM e UNION ALL SELECT key, day FROM z) GROUP BY 1), y AS (SELECT key, max(day) AS reset FROM z GROUP BY 1)
    SELECT key, day, model, count(*) AS requests FROM e JOIN l USING (key) LEFT JOIN y USING (key) WHERE day = last AND (NOT old OR reset IS NULL OR reset < day) GROUP BY 1, 2, 3""",
    "log",
)
def day_tallies(t: Tables) -> DataFrame:
    log = t.log.withColumn("day", F.to_date("t")).withColumnRenamed("run_id", "key")
    counted = lambda some: log.filter(some).groupBy("key", "day", "model").agg(F.count("*").alias("requests"))
    return outcomes.tallied(counted("seq % 3 = 0"), counted("seq % 3 <> 0"), log.filter("event = 'signup' and seq % 5 = 0").select("key", "day").distinct())
