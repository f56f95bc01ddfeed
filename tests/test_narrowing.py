"""Raw responses and planned blueprints: fences, numbers, repeated keys, nulls and empty tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from examloom.operators import blueprint, narrowing
from examloom.plans import blueprint_queries, narrowing_queries
from examloom.plans.catalogue import Tables
from examloom.storage import spread

NAME = "spark.sql.variant.allowDuplicateKeys"


def values(spark, texts: list) -> list:
    """What each text is read as: None, or (JSON,)."""
    df = narrowing.read_responses(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"))
    found = {r["i"]: r["v"] for r in df.select("i", F.to_json("value").alias("v")).collect()}
    return [None if found[i] is None else json.loads(found[i]) for i in range(len(texts))]


def test_fences(spark):
    good = ['{"a":1}', '\n```json\n{"a":1}\n```', '```\n{"a":1}\n```', ' ```json  \n\n {"a":1} \n```  \n', '```json\r\n{"a":1}\n```', ' {"a":1} ']
    assert values(spark, good) == [{"a": 1}] * len(good)
    # Marks on the line of the JSON, only one mark, text around, nothing within.
    bad = ['```json {"a":1} ```', '```json\n{"a":1}```', '{"a":1}\n```', 'x\n```\n{"a":1}\n```', "```\n\n```", "", None, "{", '{"a":1} {"b":2}', "[1],[2]", "NaN"]
    assert values(spark, bad) == [None] * len(bad)
    assert values(spark, ["[1, 2]", "3", '"x"', "true"]) == [[1, 2], 3, "x", True]


def test_repeated_keys(spark):
    before = spark.conf.get(NAME)
    assert values(spark, ['{"a":1,"a":2,"b":{"c":1,"c":3}}']) == [{"a": 2, "b": {"c": 3}}]
    assert spark.conf.get(NAME) == before


@pytest.mark.parametrize(("written", "page", "count"), [("1", 1, 1), ("1.0", 1, 1), ("2.5", None, 2), ("0", None, 0), ("-3", None, 0), ('"1"', None, None), ("null", None, None), ("1e2", 100, 100), ("true", None, None), ("[1]", None, None)])
def test_numbers(spark, written, page, count):
    df = narrowing.read_responses(spark.createDataFrame([(f'{{"n":{written}}}',)], "text string"))
    v = F.col("value")
    r = df.select(narrowing.page_at(v, "$.n").alias("p"), narrowing.count_at(v, "$.n").alias("c"), narrowing.page_at(v, "$.gone").alias("g")).first()
    assert (r["p"], r["c"], r["g"]) == (page, count, None)


def test_counts_and_windows(spark):
    """108.0 with three rows is under-extracted; a window with owner_page 1.0 is read."""
    q = {"ref": "a", "printed_label": "", "owner_page": 1.0, "source_pages": [2, 1.0, 1, 0, "3", 1.5], "anchor": "x", "options_present": True, "case_stem_key": None, "section_hint": "", "visible_year": "", "answer_present": False}
    page = {"page": 1.0, "contains_question_start": True, "first_printed_label": "", "last_printed_label": "", "section_hint": ""}
    texts = [json.dumps({"document_profile": {"question_count": n}, "planned_rows": [1, 2, 3], "questions": [q], "pages": [page]}) for n in (108.0, 3, 3.5, "108")]
    df = narrowing.read_responses(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"))
    assert [r["under_extracted"] for r in narrowing.declared_counts(df).orderBy("i").collect()] == [True, False, True, False]
    window = narrowing.index_windows(df).orderBy("i").first()
    assert window["ok"] and window["questions"][0]["owner_page"] == 1 and window["questions"][0]["source_pages"] == [1, 2]


def validate(spark, texts: list, pages=((0, 1), (0, 2), (0, 3))) -> blueprint.Blueprints:
    responses = narrowing.read_responses(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "run_id long, text string"))
    return blueprint.validated(responses, spark.createDataFrame([p for i in range(len(texts)) for p in [(i, n) for _, n in pages]], "run_id long, page int"))


def test_each_rule_is_told_once(spark):
    """Every case but the whole ones breaks some rule, and all rules are broken by some case."""
    found = validate(spark, [c.replace("@", "7") for c in blueprint_queries.CASES])
    rows = found.violations.collect()
    whole = {r["run_id"] for r in found.profiles.collect()}
    assert {r["run_id"] for r in rows} | whole == set(range(len(blueprint_queries.CASES))) and not whole & {r["run_id"] for r in rows}
    told = {r["violation"] for r in rows}
    assert told >= {"not_json", "not_an_object", "csv_schema", "document_profile", "document_profile.question_count", "document_profile.answer_policy", "assets", "planned_rows", "worker_constraints", "worker_constraints.may_add_rows", "asset_id", "page", "box_2d", "output_path", "linked_row_ids",
                    "id", "topic", "subtopic", "year", "id_empty", "image_urls", "question_assembly", "final_format", "regions", "question_prompt_missing", "case_stem_missing", "correct_index_policy", "worker_task", "id_repeated", "image_without_asset", "answer_evidence_missing"}
    assert len(rows) == len({(r["run_id"], r["place"], r["violation"], r["detail"]) for r in rows}) + 1  # one picture is named twice in a row
    assert {r["run_id"]: r["question_count"] for r in found.profiles.collect()}[0] == 3


def test_nothing_rendered(spark):
    rows = validate(spark, [blueprint_queries.CASES[0]], pages=()).violations.collect()
    assert {r["violation"] for r in rows} == {"page", "question_prompt_missing", "case_stem_missing"}


def test_no_responses(spark):
    found = validate(spark, [])
    assert [df.count() for df in found] == [0, 0, 0, 0]
    assert [r["violation"] for r in validate(spark, [None]).violations.collect()] == ["not_json"]


def test_types_without_schemas(spark):
    texts = ['{"a":1}', "{}", "[]", "[1,null]", "null", "3", '"x"', "true", "no json"]
    df = narrowing.read_responses(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"))
    read = df.select("i", narrowing.is_record(F.col("value")).alias("record"), F.size(narrowing.items_at(F.col("value"), "$")).alias("n"), narrowing.is_record(F.col("value"), "$.a").alias("inner"))
    assert [(r["record"], r["n"], r["inner"]) for r in read.orderBy("i").collect()] == [(True, None, False), (True, None, False), (False, 0, False), (False, 2, False), *[(False, None, False)] * 5]
    # The schema of all that an object or array holds is not made to tell what it is.
    assert "schema_of_variant" not in read._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("name", ["quota_rows", "indexed_questions", "boxed_figure_rows", "audit_reports", "resolved_questions", "under_extracted", "index_windows"])
def test_responses_are_parsed_once_on_all_cores(spark, name):
    tables = Tables(spark, "/root/testdata/sf0.001")
    assert "parse_json" not in getattr(narrowing_queries, name)(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert spread(spark.range(8).coalesce(1), "id").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_blueprints_are_read_part_by_part(spark):
    responses = narrowing.read_responses(spark.createDataFrame([(1, blueprint_queries.CASES[0])], "run_id long, text string"))
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "$.question_assembly.mode" not in plan(blueprint._rows(responses)) and "$.regions.options.page" not in plan(blueprint._rows(responses))
    assert plan(blueprint._heads(responses)).count("schema_of_variant") <= 20
