"""Queries over raw responses, derived from ``part``: texts with and without fences, cut ones, and values of wrong types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examloom.operators import narrowing
from examloom.plans.catalogue import Tables, query
from examloom.plans.oracle_relations import trim
from examloom.storage import materialize, spread

_DAY = "CASE WHEN p_partkey % 23 = 0 THEN '5' ELSE '\"2024-01-0' || CAST(p_partkey % 9 + 1 AS STRING) || '\"' END"


def _question(i: int) -> str:
    page = f"CAST(p_partkey % 50 + {i} AS STRING) || CASE p_partkey % 25 WHEN 0 THEN '.0' WHEN 1 THEN '.5' ELSE '' END"
    return (
        f"""'{{"ref":"w1q{i}","printed_label":"' || CAST(p_partkey % 9 AS STRING) || '","owner_page":' || CASE WHEN p_partkey % 11 = {i} THEN '"x"' ELSE {page} END || ',"source_pages":[' || {page} || ',0,' || {page} || ',"3",1],"anchor":"' || p_name || '"'"""
        + f""" || CASE WHEN p_partkey % 13 = {i} THEN '' ELSE ',"options_present":true' END || ',"case_stem_key":' || CASE WHEN p_partkey % 4 = 0 THEN 'null' ELSE '"s"' END || ',"section_hint":"","visible_year":""'"""
        + """ || CASE WHEN p_partkey % 5 = 0 THEN ',"evidence_state":"' || CASE WHEN p_partkey % 2 = 0 THEN 'inline' ELSE 'other' END || '"' ELSE ',"answer_present":false' END || '}'"""
    )


_FIGURE = """'{"page":' || CAST(p_partkey % 6 AS STRING) || ',"anchor":"a","linked_refs":[' || CASE WHEN p_partkey % 7 = 0 THEN '1' ELSE '"w1q1",2,"w1q2"' END || '],"box_2d":[10,20,' || CAST(p_size AS STRING) || ',' || CASE WHEN p_partkey % 8 = 0 THEN '1200' ELSE '90.5' END || ']}'"""
#: One text for both engines: the two read the same table, and this is data, not a rule.
RESPONSE = f"""CASE p_partkey % 12 WHEN 0 THEN '```json' || chr(10) WHEN 3 THEN ' ' || chr(10) || '```  ' || chr(10) WHEN 6 THEN '```json ' WHEN 9 THEN '```json' || chr(13) || chr(10) || chr(10) ELSE '' END || '{{"questions":[' || {_question(1)} || ',' || {_question(2)} || '],"pages":[{{"page":' || CASE WHEN p_partkey % 17 = 0 THEN 'null' ELSE '1' END
 || ',"contains_question_start":true,"first_printed_label":"","last_printed_label":"","section_hint":"h"}}],"figures":[' || {_FIGURE} || ',{{"page":2,"anchor":"b","linked_refs":["w1q1"],"box_2d":[1,2,3,4]}}],"type":"' || CASE p_partkey % 6 WHEN 0 THEN 'mixed' WHEN 1 THEN 'maybe' ELSE 'inline_marks' END
 || '","marking_style":' || CASE WHEN p_partkey % 14 = 0 THEN '3' ELSE '"circle"' END || ',"evidence":[{{"ref":"w1q1","state":"' || CASE WHEN p_partkey % 10 = 0 THEN 'gone' ELSE 'separate' END || '"}}],"audit_pass":' || CASE WHEN p_partkey % 9 = 0 THEN '"yes"' WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END
 || ',"risk_class":"' || CASE WHEN p_partkey % 12 = 0 THEN 'unknown' ELSE 'safe_to_import' END || '","failed_rows":' || CASE WHEN p_partkey % 15 = 0 THEN '{{}}' ELSE '[]' END || ',"global_failures":[],"document_profile":{{"question_count":' || CASE p_partkey % 16 WHEN 0 THEN '"4"' WHEN 1 THEN '108.0' WHEN 2 THEN '2.5' ELSE CAST(p_size % 5 AS STRING) END || '}},"planned_rows":[1,2]'
 || ',"resolved":[{{"id":"' || CAST(p_partkey AS STRING) || '","question":' || CASE WHEN p_partkey % 18 = 0 THEN '7' ELSE '"q"' END || '}},{{"id":"' || CAST(p_partkey + CASE WHEN p_partkey % 20 = 0 THEN 5 ELSE 0 END AS STRING) || '","question":"r"}}],"day":' || {_DAY} || ',' || CASE WHEN p_partkey % 21 = 0 THEN '"count":4' ELSE '"counts":{{"even":' || CASE p_partkey % 22 WHEN 0 THEN '-3' WHEN 1 THEN '2.7' ELSE CAST(p_size AS STRING) END || ',"odd":"x"}}' END
 || '}}' || CASE WHEN p_partkey % 19 = 0 THEN '{{' ELSE '' END || CASE p_partkey % 12 WHEN 0 THEN chr(10) || '```' WHEN 3 THEN chr(10) || '```  ' || chr(10) WHEN 6 THEN ' ```' WHEN 9 THEN ' ' || chr(10) || '```' WHEN 10 THEN chr(10) ELSE '' END"""
#: The reference's rule: the marks of a fence stand on lines of their own.
_FENCE = r"(?s)^```(?:json)?\s*\n(.*?)\n```\s*$"
_J = f"""WITH r AS (SELECT p_partkey, {RESPONSE} AS t FROM part), b0 AS (SELECT p_partkey, {trim("t")} AS t FROM r), b AS (SELECT p_partkey, CASE WHEN regexp_matches(t, '{_FENCE}') THEN regexp_extract(t, '{_FENCE}', 1) ELSE t END AS t FROM b0),
j AS (SELECT p_partkey, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS v FROM b)"""
_IS = lambda path, kind, of="v": f"coalesce(json_type({of}, '{path}') = '{kind}', false)"
_NUMBER = lambda path, of="v": f"CASE WHEN json_type({of}, '{path}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN TRY_CAST(json_extract_string({of}, '{path}') AS DOUBLE) END"
_PAGE = lambda path, of="v": f"coalesce({_NUMBER(path, of)} >= 1 AND {_NUMBER(path, of)} = floor({_NUMBER(path, of)}), false)"


def responses(t: Tables) -> DataFrame:
    # Written once: filters and lists over values would else make and parse the texts again for each of their parts.
    texts = spread(t.part.select("p_partkey", "p_name", "p_size"), "p_partkey").select("p_partkey", F.expr(RESPONSE).alias("text"))
    return materialize(narrowing.read_responses(texts).select("p_partkey", "value")).withColumn("run_id", F.col("p_partkey"))


_GOOD_QUESTION = " AND ".join(
    [*(_IS(f"$.{k}", "VARCHAR", "q") for k in ("ref", "printed_label", "anchor", "section_hint", "visible_year")), _PAGE("$.owner_page", "q"), _IS("$.options_present", "BOOLEAN", "q"), "coalesce(json_type(q, '$.case_stem_key') IN ('VARCHAR', 'NULL'), false)",
     f"({_IS('$.answer_present', 'BOOLEAN', 'q')} OR coalesce(json_extract_string(q, '$.evidence_state') IN ('none', 'inline', 'separate', 'ambiguous', 'illegible'), false))"]
)
_GOOD_PAGE = " AND ".join([_PAGE("$.page", "p"), _IS("$.contains_question_start", "BOOLEAN", "p"), *(_IS(f"$.{k}", "VARCHAR", "p") for k in ("first_printed_label", "last_printed_label", "section_hint"))])


@query(
    f"""{_J}, e AS (SELECT p_partkey, CASE WHEN v IS NULL THEN 1 ELSE len(list_filter(CAST(v->'$.questions' AS JSON[]), lambda q: NOT ({_GOOD_QUESTION}))) + len(list_filter(CAST(v->'$.pages' AS JSON[]), lambda p: NOT ({_GOOD_PAGE}))) END AS n FROM j)
    SELECT p_partkey, n = 0 AS ok, CAST(n AS INT) AS errors FROM e"""
)
def index_windows(t: Tables) -> DataFrame:
    return narrowing.index_windows(responses(t)).select("p_partkey", "ok", F.size("errors").alias("errors"))


@query(
    f"""{_J}, q AS (SELECT p_partkey, unnest(CAST(v->'$.questions' AS JSON[])) AS q FROM j WHERE v IS NOT NULL AND len(list_filter(CAST(v->'$.questions' AS JSON[]), lambda q: NOT ({_GOOD_QUESTION}))) = 0 AND len(list_filter(CAST(v->'$.pages' AS JSON[]), lambda p: NOT ({_GOOD_PAGE}))) = 0)
    SELECT p_partkey, q->>'$.ref' AS ref, CAST(CAST(q->>'$.owner_page' AS DOUBLE) AS BIGINT) AS owner_page, array_to_string(list_sort(list_distinct(list_transform(list_filter(CAST(q->'$.source_pages' AS JSON[]), lambda x: {_PAGE("$", "x")}), lambda x: CAST(CAST(x AS DOUBLE) AS BIGINT)))), ',') AS source_pages,
    q->>'$.anchor' AS anchor, coalesce(CAST(q->>'$.answer_present' AS BOOLEAN), q->>'$.evidence_state' = 'inline') AS answer_present FROM q"""
)
def indexed_questions(t: Tables) -> DataFrame:
    q = materialize(narrowing.index_windows(responses(t)).select("p_partkey", "ok", "questions")).filter("ok").select("p_partkey", F.explode("questions").alias("q"))
    return q.select("p_partkey", "q.ref", "q.owner_page", F.array_join(F.transform("q.source_pages", lambda p: p.cast("string")), ",").alias("source_pages"), "q.anchor", "q.answer_present")


@query(f"{_J} SELECT p_partkey, v IS NOT NULL AND p_partkey % 6 <> 0 AND p_partkey % 7 <> 0 AS ok FROM j")
def figure_detections(t: Tables) -> DataFrame:
    return narrowing.figure_detections(responses(t)).select("p_partkey", "ok")


@query(f"{_J} SELECT j.p_partkey, CAST(CASE WHEN v IS NULL THEN -1 ELSE 1 + CASE WHEN j.p_partkey % 6 <> 0 AND j.p_partkey % 7 <> 0 AND j.p_partkey % 8 <> 0 AND p_size > 10 THEN 1 ELSE 0 END END AS INT) AS figures FROM j JOIN part USING (p_partkey)")
def boxed_figures(t: Tables) -> DataFrame:
    return narrowing.boxed_figures(responses(t)).select("p_partkey", F.coalesce(F.size("figures"), F.lit(-1)).alias("figures"))


@query(
    f"""{_J}, f AS (SELECT p_partkey, unnest(CAST(v->'$.figures' AS JSON[])) AS f FROM j WHERE v IS NOT NULL), x AS (SELECT *, list_transform(CAST(f->'$.box_2d' AS JSON[]), lambda x: CASE WHEN json_type(x) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(x AS DOUBLE) END) AS b FROM f)
    SELECT p_partkey, CAST(CAST(f->>'$.page' AS DOUBLE) AS BIGINT) AS page, b[1] AS y0, b[2] AS x0, b[3] AS y1, b[4] AS x1, array_to_string(list_transform(list_filter(CAST(f->'$.linked_refs' AS JSON[]), lambda x: json_type(x) = 'VARCHAR'), lambda x: x->>'$'), '|') AS refs, f->>'$.anchor' AS anchor FROM x
    WHERE {_PAGE("$.page", "f")} AND {_IS("$.anchor", "VARCHAR", "f")} AND len(list_filter(b, lambda x: x BETWEEN 0 AND 1000)) = 4 AND len(b) = 4 AND b[3] > b[1] AND b[4] > b[2] AND len(list_filter(CAST(f->'$.linked_refs' AS JSON[]), lambda x: json_type(x) = 'VARCHAR')) > 0"""
)
def boxed_figure_rows(t: Tables) -> DataFrame:
    f = materialize(narrowing.boxed_figures(responses(t)).select("p_partkey", "figures")).select("p_partkey", F.explode("figures").alias("f"))
    return f.select("p_partkey", "f.page", *(F.get("f.box", F.lit(i)).alias(n) for i, n in enumerate(("y0", "x0", "y1", "x1"))), F.array_join("f.refs", "|").alias("refs"), "f.anchor")


@query(
    f"""{_J} SELECT p_partkey, CASE WHEN v IS NOT NULL THEN v->>'$.type' END AS policy, v IS NOT NULL AND v->>'$.type' IN ('mixed', 'inline_marks') AND {_IS("$.marking_style", "VARCHAR")} AND v->>'$.evidence[0].state' <> 'gone' AS ok FROM j"""
)
def evidence_maps(t: Tables) -> DataFrame:
    return narrowing.evidence_maps(responses(t)).select("p_partkey", "policy", "ok")


@query(
    f"""{_J}, e AS (SELECT *, CASE WHEN v IS NULL THEN 1 ELSE CAST(NOT {_IS("$.audit_pass", "BOOLEAN")} AS INT) + CAST(v->>'$.risk_class' = 'unknown' AS INT) + CAST(NOT {_IS("$.failed_rows", "ARRAY")} AS INT) END AS n FROM j)
    SELECT p_partkey, n AS errors, CASE WHEN n = 0 THEN CAST(v->>'$.audit_pass' AS BOOLEAN) END AS audit_pass, CASE WHEN n = 0 THEN v->>'$.risk_class' END AS risk FROM e"""
)
def audit_reports(t: Tables) -> DataFrame:
    return narrowing.audit_reports(responses(t)).select("p_partkey", F.size("errors").alias("errors"), "audit_pass", "risk")


@query(f"{_J} SELECT p_partkey, coalesce({_NUMBER('$.document_profile.question_count')} > len(CAST(v->'$.planned_rows' AS JSON[])), false) AS under_extracted FROM j")
def under_extracted(t: Tables) -> DataFrame:
    return narrowing.declared_counts(responses(t)).select("p_partkey", "under_extracted")


@query(f"{_J}, g AS (SELECT p_partkey, v IS NOT NULL AND p_partkey % 18 <> 0 AND p_partkey % 20 <> 0 AS ok FROM j) SELECT p_partkey AS run_id, ok, CAST(CASE WHEN ok THEN 1 ELSE 0 END AS BIGINT) AS questions FROM g")
def resolved_questions(t: Tables) -> DataFrame:
    return narrowing.resolved_questions(responses(t), t.part.select(F.col("p_partkey").alias("run_id"), F.col("p_partkey").cast("string").alias("id")))


@query(f"{_J} SELECT j.p_partkey AS key, v->>'$.day' AS day, CASE WHEN j.p_partkey % 21 = 0 THEN 'base' ELSE 'even' END AS model, CAST(CASE WHEN j.p_partkey % 21 = 0 THEN 4 WHEN j.p_partkey % 22 = 0 THEN 0 WHEN j.p_partkey % 22 = 1 THEN 2 ELSE p_size END AS BIGINT) AS requests FROM j JOIN part USING (p_partkey) WHERE v IS NOT NULL AND j.p_partkey % 23 <> 0")
def quota_rows(t: Tables) -> DataFrame:
    return narrowing.quota_rows(responses(t).withColumnRenamed("p_partkey", "key"), "base")
