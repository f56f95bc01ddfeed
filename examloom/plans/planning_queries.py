"""Queries over plans and what comes back for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examloom.operators import planning, review
from examloom.plans.catalogue import Tables, joined, query


@query("SELECT run_id, id, CASE WHEN page <= 3 THEN 'exam' ELSE 'key' END AS part FROM planned", "planned")
def exam_and_key_pages(t: Tables) -> DataFrame:
    return planning.split_pages(t.v2.withColumn("exam_pages", F.lit(3))).select("run_id", "id", "part")


@query("SELECT run_id, id, policy IN ('separate_key', 'inline_marks', 'mixed') AS claims, CASE WHEN policy IN ('uncertain', 'no_answer_key') AND page % 2 = 0 THEN 'mixed' ELSE policy END AS policy FROM planned", "planned")
def evidence_policies(t: Tables) -> DataFrame:
    return t.v2.select("run_id", "id", planning.claims_evidence(F.col("policy")).alias("claims"), planning.with_observed_marks(F.col("policy"), F.col("page") % 2 == 0).alias("policy"))


@query("SELECT id, CASE WHEN correct_index <> '' AND doc_id % 3 <> 0 THEN correct_index ELSE '' END AS answer FROM exam_rows", "exam_rows")
def confirmed_answers(t: Tables) -> DataFrame:
    return t.v1.select("id", planning.confirmed(F.col("correct_index"), F.when(F.col("doc_id") % 3 == 0, "9").otherwise(F.col("correct_index"))).alias("answer"))


@query("SELECT run_id, id, '' AS question, 0 AS n_options, '' AS correct_index, 'unreadable' AS needs_review, image_url FROM planned WHERE page % 2 = 0", "planned")
def placeholder_rows(t: Tables) -> DataFrame:
    return planning.placeholders(t.v2.filter("page % 2 = 0"), "unreadable").select("run_id", "id", "question", F.size("options").alias("n_options"), "correct_index", "needs_review", "image_url")


@query("SELECT run_id, count(*) AS n_rows, count(*) AS flagged, 0::BIGINT AS answered, count(*) AS pending, false AS safe_to_import FROM exam_rows GROUP BY 1", "exam_rows")
def degraded_counters(t: Tables) -> DataFrame:
    return planning.run_counters(planning.all_blank(t.v1, "key_unclear"))


@query("SELECT run_id, count(*) AS n_rows, count(*) FILTER (needs_review <> '') AS flagged, count(*) FILTER (correct_index <> '') AS answered, count(*) FILTER (correct_index = '') AS pending, false AS safe_to_import FROM exam_rows GROUP BY 1", "exam_rows")
def run_counters(t: Tables) -> DataFrame:
    return planning.run_counters(t.v1)


@query("SELECT CAST(count(*) FILTER (needs_review <> '') AS BIGINT) AS flags, count(*) FILTER (correct_index = '') AS pending, count(DISTINCT CASE WHEN needs_review <> '' THEN run_id END) AS flagged_runs, count(DISTINCT run_id) AS runs FROM exam_rows", "exam_rows")
def flag_totals(t: Tables) -> DataFrame:
    return planning.totals(planning.run_counters(t.v1))


@query("SELECT run_id, count(*) AS requests, CAST(sum(coalesce(k, 0)) AS BIGINT) AS tokens FROM log GROUP BY 1", "log")
def usage_totals(t: Tables) -> DataFrame:
    return planning.usage(t.log.withColumn("tokens", F.col("k")))


_FIGURES = ", figs AS (SELECT run_id, pos, id, page, image_url AS path FROM planned WHERE image_url <> '')"


@query(f"{_FIGURES} SELECT run_id, page, string_agg(id, '|' ORDER BY pos) AS linked FROM (SELECT run_id, page, pos, id FROM figs) GROUP BY 1, 2", "planned")
def figure_question_links(t: Tables) -> DataFrame:
    q = t.v2.filter("image_url <> ''").withColumn("figures", F.array("page", "page"))
    return planning.figure_rows(q).select("run_id", F.col("figure").alias("page"), joined("linked").alias("linked"))


@query(
    f"""{_FIGURES}, b AS (SELECT DISTINCT run_id, page, page // 3 AS request FROM planned WHERE page % 5 <> 0)
    SELECT f.run_id, f.id, CAST(b.request AS INT) AS request, CAST(b.place AS INT) AS place FROM figs f JOIN (SELECT *, row_number() OVER (PARTITION BY run_id, request ORDER BY page) AS place FROM b) b ON b.run_id = f.run_id AND b.page = f.page""",
    "planned",
)
def figure_hints(t: Tables) -> DataFrame:
    batch = t.v2.filter("page % 5 <> 0").select("run_id", "page", F.expr("cast(page div 3 as int)").alias("request")).distinct()
    figures = planning.on_batch_pages(t.v2.filter("image_url <> ''"), batch)
    return planning.figure_hints(figures, batch).select("run_id", "id", "request", "place")


@query("SELECT id, coalesce(new_question, question) AS question, CASE WHEN coalesce(pick < len(options), false) THEN CAST(pick AS VARCHAR) ELSE correct_index END AS correct_index FROM exam_rows LEFT JOIN edits USING (doc_id) LEFT JOIN picks USING (doc_id)", "exam_rows", "edits", "picks")
def solver_base_rows(t: Tables) -> DataFrame:
    return planning.solver_rows(t.v1, t.edits, t.picks).select("id", "question", "correct_index")


@query(f"{_FIGURES} SELECT run_id, path, page, CASE WHEN CAST(id AS BIGINT) % 20 = 0 THEN 'crop' WHEN page % 3 <> 0 THEN 'page' ELSE 'none' END AS preview FROM figs", "planned")
def figure_previews(t: Tables) -> DataFrame:
    f = t.v2.filter("image_url <> ''").withColumn("path", F.col("image_url"))
    return planning.previews(f, f.filter("doc_id % 20 = 0"), t.v2.filter("page % 3 <> 0"))


@query("SELECT run_id, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages, max(n) AS most FROM (SELECT run_id, page, count(*) AS n FROM planned GROUP BY 1, 2) GROUP BY 1", "planned")
def question_pages(t: Tables) -> DataFrame:
    return planning.question_pages(t.v2).select("run_id", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "most")


@query(", a AS (SELECT *, count(*) OVER (PARTITION BY run_id, pos) > 1 AS again FROM seen) SELECT run_id, win, page, count(*) FILTER (is_core) AS owned, bool_or(again) AS reread FROM a GROUP BY 1, 2, 3", "seen")
def owned_and_reread(t: Tables) -> DataFrame:
    return planning.owned_and_reread(t.seen)


@query("SELECT run_id, count(*) AS emitted, count(*) FILTER (is_core) AS kept, count(*) FILTER (NOT is_core) AS dropped FROM seen GROUP BY 1", "seen")
def reconcile_counts(t: Tables) -> DataFrame:
    return planning.reconcile_counts(t.seen, t.seen.filter("is_core"))


@query("SELECT run_id, ref, CAST(row_number() OVER (PARTITION BY run_id ORDER BY page, win, ordinal) AS INT) AS place FROM obs", "obs")
def ref_order(t: Tables) -> DataFrame:
    return planning.ref_order(t.seen).select("run_id", "ref", "place")


@query("SELECT needs_review, n, CAST(row_number() OVER (ORDER BY n DESC, needs_review) AS INT) AS place FROM (SELECT needs_review, count(*) AS n FROM exam_rows GROUP BY 1)", "exam_rows")
def reason_histogram(t: Tables) -> DataFrame:
    return planning.commonest_first(t.v1, "needs_review")


@query("SELECT run_id, arg_min(violation, pos) AS \"first\", count(*) AS n FROM (SELECT run_id, pos, CASE WHEN correct_index = '' THEN 'blank' ELSE needs_review END AS violation FROM exam_rows WHERE correct_index = '' OR needs_review <> '') GROUP BY 1", "exam_rows")
def first_errors(t: Tables) -> DataFrame:
    v = t.v1.filter(review.is_flagged()).select("run_id", "pos", F.when(F.col("correct_index") == "", "blank").otherwise(F.col("needs_review")).alias("violation"))
    return planning.first_errors(v)


@query(", f AS (SELECT run_id, page, pos, label, anchor FROM seen) SELECT run_id, page, label AS key, min(pos) AS seq, count(*) AS copies FROM f GROUP BY 1, 2, 3", "seen")
def merged_figures(t: Tables) -> DataFrame:
    f = t.seen.select("run_id", "page", F.array("label").alias("refs"), F.col("pos").alias("seq"), "anchor")
    return planning.merged_figures(f).select("run_id", "page", "key", "seq", "copies")


@query(
    """, s AS (SELECT topic, list(subtopic ORDER BY subtopic) AS subs FROM topics GROUP BY 1), m AS (SELECT 'ASIA' AS topic UNION ALL SELECT 'EUROPE'), x AS (SELECT list_concat([s.topic], s.subs) AS add, s.topic FROM s JOIN m USING (topic))
    SELECT topic, array_to_string(CASE WHEN topic = 'AMERICA' THEN list_concat(subs, (SELECT flatten(list(add ORDER BY topic)) FROM x)) ELSE subs END, '|') AS subtopics FROM s WHERE topic NOT IN (SELECT topic FROM m)""",
    "topics",
)
def demoted_topics(t: Tables) -> DataFrame:
    from examloom.sources import relations as rel

    listed = rel.topics(t.region, t.nation).groupBy("topic").agg(F.array_sort(F.collect_list("subtopic")).alias("subtopics"))
    moves = listed.filter(F.col("topic").isin("ASIA", "EUROPE")).select("topic", F.lit("AMERICA").alias("target"))
    return planning.demoted(listed, moves).select("topic", joined("subtopics").alias("subtopics"))


@query("SELECT run_id, id AS row_id FROM exam_rows WHERE (doc_id % 4 = 0 OR doc_id % 6 = 0) AND doc_id % 5 <> 0", "exam_rows")
def deletion_set(t: Tables) -> DataFrame:
    ids = t.v1.select("run_id", F.col("id").alias("row_id"), "doc_id")
    some = lambda k: ids.filter(F.col("doc_id") % k == 0).select("run_id", "row_id")
    return planning.deletion_set(some(4), some(6), some(5))


@query("SELECT run_id, string_agg(DISTINCT image_url, '|' ORDER BY image_url) AS images FROM exam_rows WHERE image_url <> '' GROUP BY 1", "exam_rows")
def image_paths(t: Tables) -> DataFrame:
    return planning.image_paths(t.v1).select("run_id", joined("images").alias("images"))


@query(
    """, p AS (SELECT run_id, pos, CASE WHEN run_id LIKE '%1' THEN CAST(pos % 40 AS VARCHAR) ELSE 'Q' || CAST(pos AS VARCHAR) END AS printed FROM exam_rows), k AS (SELECT run_id, count(DISTINCT printed) = count(*) AS keep FROM p GROUP BY 1)
    SELECT run_id, pos, CASE WHEN keep THEN printed ELSE CAST(row_number() OVER (PARTITION BY run_id ORDER BY pos) AS VARCHAR) END AS id FROM p JOIN k USING (run_id)""",
    "exam_rows",
)
def stitched_ids(t: Tables) -> DataFrame:
    printed = F.when(F.col("run_id").endswith("1"), (F.col("pos") % 40).cast("string")).otherwise(F.concat(F.lit("Q"), F.col("pos").cast("string")))
    return planning.stitched_ids(t.v1.select("run_id", "pos", printed.alias("printed")))


@query("SELECT doc_id, doc_id % 3 = 0 AS letters, doc_id % 3 = 1 AS numbers, doc_id % 3 = 2 AND doc_id % 4 <> 0 AS romans FROM documents")
def label_runs(t: Tables) -> DataFrame:
    labels = F.expr("case doc_id % 3 when 0 then array('A', 'B', 'C') when 1 then array('1', '2', '3') else array('i', if(doc_id % 4 = 0, 'iiv', 'ii'), 'III', 'iv') end")
    d = t.documents.select("doc_id", labels.alias("l"))
    return d.select("doc_id", *(planning.sequential(F.col("l"), s).alias(s) for s in ("letters", "numbers", "romans")))


@query(
    """, c AS (SELECT run_id, pos // 7 AS chunk, count(*) AS n FROM exam_rows GROUP BY 1, 2)
    SELECT run_id, CAST(chunk AS INT) AS chunk, 0 AS half, CAST((n + 1) // 2 AS INT) AS n, n = 1 AS placeholder FROM c UNION ALL SELECT run_id, CAST(chunk AS INT), 1, CAST(n // 2 AS INT), false FROM c WHERE n > 1""",
    "exam_rows",
)
def halved_chunks(t: Tables) -> DataFrame:
    c = t.v1.groupBy("run_id", F.expr("cast(pos div 7 as int)").alias("chunk")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return planning.halved(c).select("run_id", "chunk", "half", F.size("ids").alias("n"), "placeholder")


@query("SELECT run_id, pos, id FROM exam_rows WHERE correct_index = '' OR needs_review <> '' OR doc_id % 50 = 7", "exam_rows")
def pinned_rows(t: Tables) -> DataFrame:
    rows = t.v1
    return planning.with_pinned(rows.filter(review.is_flagged()), rows, rows.filter("doc_id % 50 = 7").select("run_id", "id"))
