"""Queries over planned blueprints: one text for each rule that a response can break, and a few that are right, dealt to the rows of ``part``."""

from __future__ import annotations

import copy
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examloom.operators import blueprint, narrowing
from examloom.operators.blueprint import CONSTRAINTS, CSV_SCHEMA, FORMATS, REGIONS
from examloom.plans.catalogue import Tables, query
from examloom.storage import spread

_BOX = [10, 20.5, 30, 40]


def _region(page: float = 1) -> dict:
    return {"page": page, "box_2d": _BOX, "anchor": "a"}


def _row(name: str, **more) -> dict:
    row = {
        "id": name, "topic": "", "subtopic": "s", "year": "2024", "image_urls": ["images/1.png"], "question_assembly": {"mode": "plain_question_prompt", "final_format": "{question_prompt}"},
        "regions": {"case_stem": None, "question_prompt": _region(), "options": _region(2), "answer_evidence": _region(3)},
        "correct_index_policy": {"type": "extract_visible_evidence", "value": "", "needs_review": ""}, "worker_task": {"case_stem_required": False, "read_regions_only": True},
    }
    return {**row, **more}


_WHOLE = {
    "csv_schema": list(CSV_SCHEMA), "document_profile": {"page_count": 3, "question_count": 17, "question_pages": [1, "x", 2.0], "answer_policy": {"type": "mixed", "answer_key_present": True, "marking_style": "circle"}},
    "assets": [{"asset_id": "f1", "kind": "figure", "page": 1, "box_2d": _BOX, "output_path": "images/1.png", "linked_row_ids": ["q1"]}, {"asset_id": "f2", "page": 1.0, "box_2d": [0, 0, 0, 0], "output_path": "images/2.png", "linked_row_ids": [], "anchor": "b"}],
    "planned_rows": [_row("q@"), _row("r@", image_urls=[]), _row("s@", question_assembly={"mode": "case_stem_plus_question_prompt", "final_format": "{case_stem}\n\n{question_prompt}"}, regions={"case_stem": _region(), "question_prompt": _region(3)}, correct_index_policy={"type": "blank_policy", "value": "", "needs_review": ""})],
    "worker_constraints": dict.fromkeys(CONSTRAINTS, False),
}
_GONE = object()


def _broken(*path, to=_GONE) -> str:
    """The whole blueprint with one thing changed or taken out."""
    b = copy.deepcopy(_WHOLE)
    at = b
    for step in path[:-1]:
        at = at[step]
    if to is _GONE:
        del at[path[-1]]
    else:
        at[path[-1]] = to
    return json.dumps(b)


_ROW, _SECOND, _CASE = ("planned_rows", 0), ("planned_rows", 1), ("planned_rows", 2)
#: One text for both engines: this is data, not a rule. ``@`` is the number of the part.
CASES = [
    json.dumps(_WHOLE), "```json\n" + json.dumps(_WHOLE) + "\n```", "no json", "[1]",
    _broken("csv_schema", 0, to="row"), _broken("csv_schema"), _broken("csv_schema", to=[*CSV_SCHEMA, "x"]), _broken("csv_schema", 1, to=3),
    _broken("document_profile"), _broken("document_profile", "question_count", to="17"), _broken("document_profile", "answer_policy"), _broken("document_profile", "answer_policy", "type", to="other"), _broken("document_profile", "page_count"),
    _broken("assets"), _broken("assets", 0, to=7), _broken("assets", 0, "asset_id", to=""), _broken("assets", 1, "page", to=9), _broken("assets", 1, "page", to="1"), _broken("assets", 1, "box_2d", to=[1, 2, 3]), _broken("assets", 0, "output_path", to=None), _broken("assets", 0, "linked_row_ids", to=["a", 1]),
    _broken("planned_rows"), _broken(*_ROW, to="q"), *(_broken(*_ROW, c) for c in ("id", "topic", "subtopic", "year")), _broken(*_ROW, "id", to=""), _broken(*_ROW, "image_urls", to="images/1.png"), _broken(*_ROW, "image_urls", to=["images/9.png", "images/1.png"]),
    _broken(*_ROW, "question_assembly"), _broken(*_ROW, "question_assembly", "mode", to="other"), _broken(*_ROW, "question_assembly", "final_format", to="{case_stem}"), _broken(*_CASE, "question_assembly", "final_format", to=FORMATS["case_stem_plus_question_prompt"][1]),
    _broken(*_CASE, "question_assembly", "final_format", to="{question_prompt}"), _broken(*_ROW, "regions"), *(_broken(*_ROW, "regions", c, to=None) for c in REGIONS), _broken(*_CASE, "regions", "case_stem"), _broken(*_ROW, "regions", "options", to=[1]), _broken(*_ROW, "regions", "options", "page", to=2.5),
    _broken(*_ROW, "regions", "question_prompt", "page", to=4), _broken(*_ROW, "regions", "answer_evidence", "box_2d", to=[1, 2, 3, "4"]), _broken(*_ROW, "correct_index_policy", "value", to=1), _broken(*_ROW, "correct_index_policy"), _broken(*_ROW, "worker_task", to=[]), _broken(*_SECOND, "id", to="q@"),
    _broken("planned_rows", to=[_row("q@", image_urls=[]), _row("q@", image_urls=[]), _row("q@", image_urls=["x", "x"])]), _broken("planned_rows", to=[]), _broken("worker_constraints"), _broken("worker_constraints", "may_add_rows", to=True), _broken("worker_constraints", "may_change_answer_policy"),
    _broken("document_profile", "answer_policy", "type", to="uncertain").replace('"answer_evidence": {', '"unused": {'), json.dumps(_WHOLE).replace('"answer_evidence": {', '"unused": {'),
]
_quoted = lambda text: "'" + text.replace("'", "''").replace("\\", "\\\\") + "'"


def _text(spark: bool) -> str:
    """The case of a part as SQL. Spark reads a backslash in a literal as an escape."""
    quote = _quoted if spark else lambda text: "'" + text.replace("'", "''") + "'"
    cases = " ".join(f"WHEN {k} THEN {quote(c)}" for k, c in enumerate(CASES))
    return f"replace(CASE p_partkey % {len(CASES)} {cases} END, '@', CAST(p_partkey AS STRING))"


def blueprints(t: Tables) -> blueprint.Blueprints:
    responses = narrowing.read_responses(spread(t.part.select("p_partkey"), "p_partkey").select(F.col("p_partkey").alias("run_id"), F.expr(_text(True)).alias("text")))
    # A third of the runs lacks a page.
    rendered = t.part.select(F.col("p_partkey").alias("run_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page"), "p_size").filter("p_size % 9 <> 0 or page <> 2")
    return blueprint.validated(responses, rendered)


_IS = lambda of, path, kind: f"coalesce(json_type({of}, '{path}') = '{kind}', false)"
_STRINGS = lambda of, path: f"coalesce(json_type({of}, '{path}') = 'ARRAY' AND len(list_filter(TRY_CAST({of}->'{path}' AS JSON[]), lambda y: json_type(y) <> 'VARCHAR')) = 0, false)"
_NUMBER = lambda of, path: f"coalesce(json_type({of}, '{path}') IN ('UBIGINT', 'BIGINT', 'DOUBLE'), false)"
_BOXED = lambda of, path: f"coalesce(json_type({of}, '{path}') = 'ARRAY' AND json_array_length({of}, '{path}') = 4 AND len(list_filter(TRY_CAST({of}->'{path}' AS JSON[]), lambda y: json_type(y) NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE'))) = 0, false)"
_PAGED = lambda of, path: f"({_NUMBER(of, path)} AND coalesce(list_contains(pages, TRY_CAST({of}->>'{path}' AS DOUBLE)), false))"
_NOT = lambda test, name: f"CASE WHEN NOT ({test}) THEN '{name}' END"
_KNOWN = "coalesce(v->>'$.document_profile.answer_policy.type' IN ('no_answer_key', 'separate_key', 'inline_marks', 'mixed', 'uncertain'), false) AND " + _IS("v", "$.document_profile.answer_policy.type", "VARCHAR")
_PLAIN_OK = "r->>'$.question_assembly.mode' = 'plain_question_prompt' AND r->>'$.question_assembly.final_format' = '{question_prompt}'"
_CASE_OK = "r->>'$.question_assembly.mode' = 'case_stem_plus_question_prompt' AND r->>'$.question_assembly.final_format' IN ('{case_stem}' || chr(10) || chr(10) || '{question_prompt}', 'Case stem: {case_stem}' || chr(10) || 'Question: {question_prompt}')"
_ASSEMBLED = f"coalesce(r->>'$.question_assembly.mode' IN ('plain_question_prompt', 'case_stem_plus_question_prompt'), false) AND {_IS('r', '$.question_assembly.final_format', 'VARCHAR')}"
_GIVEN = lambda n: f"coalesce(json_type(r, '$.regions.{n}') <> 'NULL', false)"
_WRONG = lambda n: f"CASE WHEN {_GIVEN(n)} THEN CASE WHEN NOT {_IS('r', f'$.regions.{n}', 'OBJECT')} THEN 'not_an_object' WHEN NOT {_PAGED('r', f'$.regions.{n}.page')} THEN 'page' WHEN NOT {_BOXED('r', f'$.regions.{n}.box_2d')} THEN 'box_2d' END END"
_SHOWN = lambda n: f"({_GIVEN(n)} AND ({_WRONG(n)}) IS NULL)"
_LIST = lambda *tests: f"list_filter([{', '.join(tests)}], lambda y: y IS NOT NULL)"
_HEAD = _LIST(
    f"CASE WHEN NOT {_STRINGS('v', '$.csv_schema')} OR list_transform(TRY_CAST(v->'$.csv_schema' AS JSON[]), lambda y: y->>'$') <> {list(CSV_SCHEMA)} THEN 'csv_schema' END", _NOT(_IS("v", "$.document_profile", "OBJECT"), "document_profile"),
    f"CASE WHEN {_IS('v', '$.document_profile', 'OBJECT')} AND NOT {_NUMBER('v', '$.document_profile.question_count')} THEN 'document_profile.question_count' END", f"CASE WHEN {_IS('v', '$.document_profile', 'OBJECT')} AND NOT ({_KNOWN}) THEN 'document_profile.answer_policy' END",
    _NOT(_IS("v", "$.assets", "ARRAY"), "assets"), _NOT(_IS("v", "$.planned_rows", "ARRAY"), "planned_rows"), _NOT(_IS("v", "$.worker_constraints", "OBJECT"), "worker_constraints"),
    *(f"CASE WHEN {_IS('v', '$.worker_constraints', 'OBJECT')} AND NOT coalesce(json_type(v, '$.worker_constraints.{c}') = 'BOOLEAN' AND v->>'$.worker_constraints.{c}' = 'false', false) THEN 'worker_constraints.{c}' END" for c in CONSTRAINTS),
)
_ASSET = _LIST(
    f"CASE WHEN NOT {_IS('a', '$.asset_id', 'VARCHAR')} OR a->>'$.asset_id' = '' THEN 'asset_id' END", _NOT(_PAGED("a", "$.page"), "page"), _NOT(_BOXED("a", "$.box_2d"), "box_2d"), f"CASE WHEN NOT {_IS('a', '$.output_path', 'VARCHAR')} OR a->>'$.output_path' = '' THEN 'output_path' END", _NOT(_STRINGS("a", "$.linked_row_ids"), "linked_row_ids")
)
_POLICY = " AND ".join(_IS("r", f"$.correct_index_policy.{c}", "VARCHAR") for c in ("type", "value", "needs_review"))
_PLANNED = _LIST(
    *(_NOT(_IS("r", f"$.{c}", "VARCHAR"), c) for c in ("id", "topic", "subtopic", "year")), "CASE WHEN r->>'$.id' = '' THEN 'id_empty' END", _NOT(_STRINGS("r", "$.image_urls"), "image_urls"), _NOT(_ASSEMBLED, "question_assembly"), f"CASE WHEN {_ASSEMBLED} AND NOT ({_PLAIN_OK}) AND NOT ({_CASE_OK}) THEN 'final_format' END",
    _NOT(_IS("r", "$.regions", "OBJECT"), "regions"), f"CASE WHEN {_IS('r', '$.regions', 'OBJECT')} AND NOT {_SHOWN('question_prompt')} THEN 'question_prompt_missing' END", f"CASE WHEN {_ASSEMBLED} AND r->>'$.question_assembly.mode' = 'case_stem_plus_question_prompt' AND NOT {_SHOWN('case_stem')} THEN 'case_stem_missing' END",
    _NOT(_POLICY, "correct_index_policy"), _NOT(_IS("r", "$.worker_task", "OBJECT"), "worker_task"),
)
_FENCE = r"(?s)^```(?:json)?\s*\n(.*?)\n```\s*$"
_PARSED = f"""WITH t AS (SELECT p_partkey AS run_id, {_text(False)} AS t, CASE WHEN p_size % 9 = 0 THEN [1.0, 3.0]::DOUBLE[] ELSE [1.0, 2.0, 3.0]::DOUBLE[] END AS pages FROM part), j0 AS (SELECT run_id, pages, CASE WHEN regexp_matches(t, '{_FENCE}') THEN regexp_extract(t, '{_FENCE}', 1) ELSE t END AS t FROM t),
    j AS (SELECT run_id, pages, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS v FROM j0), o AS (SELECT * FROM j WHERE v IS NOT NULL AND json_type(v) = 'OBJECT'),
    a0 AS (SELECT run_id, pages, unnest(TRY_CAST(v->'$.assets' AS JSON[])) AS a, generate_subscripts(TRY_CAST(v->'$.assets' AS JSON[]), 1) - 1 AS i FROM o WHERE json_type(v, '$.assets') = 'ARRAY'), a AS (SELECT run_id, i, a, CASE WHEN json_type(a) <> 'OBJECT' THEN ['not_an_object'] ELSE {_ASSET} END AS broken FROM a0),
    r0 AS (SELECT run_id, pages, unnest(TRY_CAST(v->'$.planned_rows' AS JSON[])) AS r, generate_subscripts(TRY_CAST(v->'$.planned_rows' AS JSON[]), 1) - 1 AS i FROM o WHERE json_type(v, '$.planned_rows') = 'ARRAY'),
    r AS (SELECT run_id, i, r, CASE WHEN json_type(r) <> 'OBJECT' THEN ['not_an_object'] ELSE {_PLANNED} END AS broken, CASE WHEN json_type(r) = 'OBJECT' THEN {_LIST(*(f"CASE WHEN ({_WRONG(n)}) IS NOT NULL THEN '.regions.{n}|' || ({_WRONG(n)}) END" for n in REGIONS))} ELSE [] END AS wrong, {_SHOWN('answer_evidence')} AS evidence FROM r0),
    g AS (SELECT run_id, i, r, evidence, r->>'$.id' AS id FROM r WHERE len(broken) = 0 AND len(wrong) = 0), p AS (SELECT run_id FROM o WHERE v->>'$.document_profile.answer_policy.type' IN ('separate_key', 'inline_marks', 'mixed')),
    x AS (SELECT run_id, '' AS place, unnest(CASE WHEN v IS NULL THEN ['not_json'] WHEN json_type(v) <> 'OBJECT' THEN ['not_an_object'] ELSE {_HEAD} END) AS violation, '' AS detail FROM j
    UNION ALL SELECT run_id, 'assets[' || i || ']', unnest(broken), '' FROM a UNION ALL SELECT run_id, 'planned_rows[' || i || ']', unnest(broken), '' FROM r UNION ALL SELECT run_id, 'planned_rows[' || i || ']' || split_part(w, '|', 1), split_part(w, '|', 2), '' FROM (SELECT run_id, i, unnest(wrong) AS w FROM r)
    UNION ALL SELECT run_id, 'planned_rows[' || i || ']', 'id_repeated', id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, id ORDER BY i) AS k FROM g) WHERE k > 1
    UNION ALL SELECT run_id, 'planned_rows[' || i || ']', 'image_without_asset', u FROM (SELECT run_id, i, unnest(list_transform(TRY_CAST(r->'$.image_urls' AS JSON[]), lambda y: y->>'$')) AS u FROM g) ANTI JOIN (SELECT run_id, a->>'$.output_path' AS u FROM a WHERE len(broken) = 0) USING (run_id, u)
    UNION ALL SELECT run_id, 'planned_rows[' || i || ']', 'answer_evidence_missing', '' FROM g SEMI JOIN p USING (run_id) WHERE NOT evidence AND r->>'$.correct_index_policy.needs_review' = '' AND NOT starts_with(r->>'$.correct_index_policy.type', 'blank'))"""


@query(f"{_PARSED} SELECT run_id, place, violation, detail FROM x")
def blueprint_violations(t: Tables) -> DataFrame:
    return blueprints(t).violations


@query(f"""{_PARSED} SELECT run_id, CAST(i AS INT) AS i, id, r->>'$.question_assembly.mode' AS mode, array_to_string(list_transform(TRY_CAST(r->'$.image_urls' AS JSON[]), lambda y: y->>'$'), '|') AS image_urls, TRY_CAST(r->>'$.regions.question_prompt.page' AS DOUBLE) AS prompt_page, TRY_CAST(r->>'$.regions.question_prompt.box_2d[1]' AS DOUBLE) AS prompt_left,
    TRY_CAST(r->>'$.regions.options.page' AS DOUBLE) AS options_page, r->>'$.correct_index_policy.type' AS policy_type, coalesce(r->>'$.worker_task.read_regions_only' = 'true', false) AS read_regions_only FROM g ANTI JOIN x USING (run_id)""")  # fmt: skip
def blueprint_rows(t: Tables) -> DataFrame:
    rows = blueprints(t).rows
    return rows.select("run_id", "i", "id", "mode", F.array_join("image_urls", "|").alias("image_urls"), F.col("question_prompt.page").alias("prompt_page"), F.get("question_prompt.box", F.lit(1)).alias("prompt_left"), F.col("options.page").alias("options_page"), "policy_type", "read_regions_only")


@query(f"""{_PARSED}, n AS (SELECT run_id, count(*) AS n FROM g GROUP BY 1) SELECT o.run_id, coalesce(CASE WHEN {_NUMBER('v', '$.document_profile.page_count')} THEN TRY_CAST(v->>'$.document_profile.page_count' AS DOUBLE) END, len(pages)::DOUBLE) AS page_count, coalesce(n, 0) AS question_count,
    array_to_string(list_transform(list_filter(TRY_CAST(v->'$.document_profile.question_pages' AS JSON[]), lambda y: json_type(y) IN ('UBIGINT', 'BIGINT', 'DOUBLE')), lambda y: CAST(CAST(y AS DOUBLE) AS BIGINT)), ',') AS question_pages, v->>'$.document_profile.answer_policy.type' AS policy,
    coalesce(v->>'$.document_profile.answer_policy.answer_key_present' = 'true', false) AS answer_key_present, coalesce(v->>'$.document_profile.answer_policy.marking_style', '') AS marking_style FROM o LEFT JOIN n USING (run_id) ANTI JOIN x USING (run_id)""")  # fmt: skip
def blueprint_profiles(t: Tables) -> DataFrame:
    pages = F.array_join(F.transform("question_pages", lambda p: p.cast("bigint").cast("string")), ",")
    return blueprints(t).profiles.withColumn("question_pages", pages).select("run_id", "page_count", "question_count", "question_pages", "policy", "answer_key_present", "marking_style")


@query(f"{_PARSED} SELECT run_id, CAST(i AS INT) AS i, a->>'$.asset_id' AS asset_id, coalesce(a->>'$.kind', '') AS kind, TRY_CAST(a->>'$.page' AS DOUBLE) AS page, a->>'$.output_path' AS output_path, CAST(json_array_length(a, '$.linked_row_ids') AS INT) AS links FROM a ANTI JOIN x USING (run_id)")
def blueprint_assets(t: Tables) -> DataFrame:
    return blueprints(t).assets.select("run_id", "i", "asset_id", "kind", "page", "output_path", F.size("linked_row_ids").alias("links"))
