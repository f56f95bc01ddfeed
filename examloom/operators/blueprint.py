"""Validation of planned blueprints (F64, J18): each broken rule is a row (run_id, place, violation, detail), and blueprints without any come out typed.

A response is taken apart once, into its head, its assets and its planned rows; what refers from one part to another (pages to the rendered ones, pictures to
assets, ids to each other, answer evidence to the policy) is a join.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examloom.operators.narrowing import POLICIES, flag_at, is_record, items_at, let, number_at, string_at
from examloom.operators.planning import EVIDENCE_POLICIES
from examloom.storage import materialize

#: The columns of a run's table, the regions of a row, what a worker may not do, and the texts that a mode may be assembled to.
CSV_SCHEMA = ("id", "topic", "subtopic", "year", "question", "options", "correct_index", "image_urls", "needs_review")
REGIONS = ("case_stem", "question_prompt", "options", "answer_evidence")
CONSTRAINTS = ("may_add_rows", "may_remove_rows", "may_change_image_assignments", "may_change_answer_policy", "may_flag_planner_disagreement")
FORMATS = {"plain_question_prompt": ("{question_prompt}",), "case_stem_plus_question_prompt": ("{case_stem}\n\n{question_prompt}", "Case stem: {case_stem}\nQuestion: {question_prompt}")}
PLAIN, CASE = FORMATS
TASKS = ("case_stem_required", "read_regions_only", "must_follow_planner_structure")


class Blueprints(NamedTuple):
    """``violations``: run_id, place, violation, detail. ``profiles``, ``assets`` and ``rows`` are those of blueprints without violations."""

    violations: DataFrame
    profiles: DataFrame
    assets: DataFrame
    rows: DataFrame


def only_strings(value: Column, path: str) -> Column:
    """An array of strings; null where there is anything else."""
    return let(F.transform(items_at(value, path), lambda x: string_at(x, "$")), lambda items: F.when(F.forall(items, lambda x: x.isNotNull()), items))


def any_box(value: Column, path: str) -> Column:
    """Four finite numbers, whatever they are."""
    numbers = F.transform(items_at(value, path), lambda x: number_at(x, "$"))
    return let(numbers, lambda parts: F.when((F.size(parts) == 4) & F.forall(parts, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), parts))


def _found(*tests: tuple[Column, str]) -> Column:
    """The names of the tests that hold; a null doesn't."""
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in tests)))


def _heads(responses: DataFrame) -> DataFrame:
    v = F.col("value")
    policy = string_at(v, "$.document_profile.answer_policy.type")
    known = F.when(is_record(v, "$.document_profile.answer_policy") & policy.isin(*POLICIES), policy)
    profile = is_record(v, "$.document_profile")
    rules = _found(
        (~F.coalesce(only_strings(v, "$.csv_schema") == F.array(*map(F.lit, CSV_SCHEMA)), F.lit(False)), "csv_schema"),
        (~profile, "document_profile"),
        (profile & number_at(v, "$.document_profile.question_count").isNull(), "document_profile.question_count"),
        (profile & known.isNull(), "document_profile.answer_policy"),
        (items_at(v, "$.assets").isNull(), "assets"),
        (items_at(v, "$.planned_rows").isNull(), "planned_rows"),
        (~is_record(v, "$.worker_constraints"), "worker_constraints"),
        *((is_record(v, "$.worker_constraints") & F.coalesce(flag_at(v, f"$.worker_constraints.{c}"), F.lit(True)), f"worker_constraints.{c}") for c in CONSTRAINTS),
    )
    broken = F.when(v.isNull(), F.array(F.lit("not_json"))).when(~is_record(v), F.array(F.lit("not_an_object"))).otherwise(rules)
    pages = F.transform(items_at(v, "$.document_profile.question_pages"), lambda x: number_at(x, "$"))
    text = lambda name: F.coalesce(string_at(v, f"$.document_profile.answer_policy.{name}"), F.lit("")).alias(name)
    return responses.select(
        "run_id", broken.alias("broken"), known.alias("policy"), number_at(v, "$.document_profile.page_count").alias("page_count"), F.coalesce(F.array_compact(pages), F.array().cast("array<double>")).alias("question_pages"),
        F.coalesce(flag_at(v, "$.document_profile.answer_policy.answer_key_present"), F.lit(False)).alias("answer_key_present"), text("marking_style"), text("worker_rule"),
    )


def _assets(responses: DataFrame) -> DataFrame:
    a, each = F.col("a"), responses.filter(is_record(F.col("value"))).select("run_id", F.posexplode(items_at(F.col("value"), "$.assets")).alias("i", "a"))
    name, path, links, box = string_at(a, "$.asset_id"), string_at(a, "$.output_path"), only_strings(a, "$.linked_row_ids"), any_box(a, "$.box_2d")
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    rules = _found((blank(name), "asset_id"), (box.isNull(), "box_2d"), (blank(path), "output_path"), (links.isNull(), "linked_row_ids"))
    return each.select(
        "run_id", "i", is_record(a).alias("is_object"), F.when(is_record(a), rules).otherwise(F.array(F.lit("not_an_object"))).alias("broken"), name.alias("asset_id"), F.coalesce(string_at(a, "$.kind"), F.lit("")).alias("kind"),
        number_at(a, "$.page").alias("page"), box.alias("box"), path.alias("output_path"), links.alias("linked_row_ids"), F.coalesce(string_at(a, "$.anchor"), F.lit("")).alias("anchor"),
    )


def _rows(responses: DataFrame) -> DataFrame:
    r, each = F.col("r"), responses.filter(is_record(F.col("value"))).select("run_id", F.posexplode(items_at(F.col("value"), "$.planned_rows")).alias("i", "r"))
    fields, policy = ("id", "topic", "subtopic", "year"), ("type", "value", "needs_review")
    part = lambda path: F.try_variant_get(r, path, "variant")

    def region(name: str) -> Column:
        v = F.col(f"_{name}")
        given = F.col("has_regions") & v.isNotNull() & ~F.is_variant_null(v)
        return F.struct(F.lit(name).alias("name"), given.alias("given"), is_record(v).alias("is_object"), number_at(v, "$.page").alias("page"), any_box(v, "$.box_2d").alias("box"), string_at(v, "$.anchor").alias("anchor"))

    # Parts first, and then what is in them, so that each is read from the row once.
    parts = each.select(
        "run_id", "i", is_record(r).alias("is_object"), *(string_at(r, f"$.{c}").alias(c) for c in fields), part("$.question_assembly").alias("_assembly"), is_record(r, "$.regions").alias("has_regions"),
        *(part(f"$.regions.{n}").alias(f"_{n}") for n in REGIONS), only_strings(r, "$.image_urls").alias("image_urls"), part("$.correct_index_policy").alias("_policy"), part("$.worker_task").alias("_task"),
    )
    typed = parts.select(
        "run_id", "i", "is_object", *fields, is_record(F.col("_assembly")).alias("_assembles"), string_at(F.col("_assembly"), "$.mode").alias("_mode"), string_at(F.col("_assembly"), "$.final_format").alias("final_format"), "has_regions",
        F.array(*map(region, REGIONS)).alias("regions"), "image_urls", is_record(F.col("_policy")).alias("_has_policy"), *(string_at(F.col("_policy"), f"$.{c}").alias(f"policy_{c}") for c in policy),
        is_record(F.col("_task")).alias("_has_task"), *(F.coalesce(flag_at(F.col("_task"), f"$.{c}"), F.lit(False)).alias(c) for c in TASKS),
    )
    mode, shape = F.col("_mode"), F.col("final_format")
    assembled = F.coalesce(F.col("_assembles") & mode.isin(*FORMATS) & shape.isNotNull(), F.lit(False))
    accepted = F.when(mode == PLAIN, shape.isin(*FORMATS[PLAIN])).otherwise(shape.isin(*FORMATS[CASE]))
    rules = _found(
        *((F.col(c).isNull(), c) for c in fields),
        (F.col("id") == "", "id_empty"),
        (F.col("image_urls").isNull(), "image_urls"),
        (~assembled, "question_assembly"),
        (assembled & ~accepted, "final_format"),
        (~F.col("has_regions"), "regions"),
        (~F.col("_has_policy") | F.col("policy_type").isNull() | F.col("policy_value").isNull() | F.col("policy_needs_review").isNull(), "correct_index_policy"),
        (~F.col("_has_task"), "worker_task"),
    )
    return typed.select(
        "run_id", "i", F.when(F.col("is_object"), rules).otherwise(F.array(F.lit("not_an_object"))).alias("broken"), "is_object", "has_regions", *fields, F.when(assembled, mode).otherwise(PLAIN).alias("mode"), "final_format", "regions",
        "image_urls", *(f"policy_{c}" for c in policy), *TASKS,
    )


def validated(responses: DataFrame, rendered: DataFrame) -> Blueprints:
    """``responses``: (run_id, value), a run's one response as a variant (null: no JSON); ``rendered``: (run_id, page), the pages there are.

    Assets and rows that break a rule of their own take no part in rules between rows, so one fault isn't told twice. A number written as 1.0 is 1. The number of questions is
    that of the rows, whatever the response says. Pages, rows and assets of a run may be any number; empty tables give empty results.
    """
    responses = materialize(responses.select("run_id", "value"))
    heads, assets, rows = (materialize(take(responses)) for take in (_heads, _assets, _rows))
    pages = rendered.select("run_id", F.col("page").cast("double").alias("page"), F.lit(True).alias("there")).distinct()
    detail = F.lit("").alias("detail")
    at = lambda section: F.concat(F.lit(f"{section}["), F.col("i").cast("string"), F.lit("]"))

    asset_pages = assets.join(pages, ["run_id", "page"], "left").withColumn("broken", F.when(F.col("is_object") & F.col("there").isNull(), F.concat("broken", F.array(F.lit("page")))).otherwise(F.col("broken")))
    good_assets = asset_pages.filter(F.size("broken") == 0)

    regions = rows.filter("is_object").select("run_id", "i", F.explode("regions").alias("r")).select("run_id", "i", "r.*").filter("given").join(pages, ["run_id", "page"], "left")
    wrong = F.when(~F.col("is_object"), "not_an_object").when(F.col("there").isNull(), "page").when(F.col("box").isNull(), "box_2d")
    regions = materialize(regions.select("run_id", "i", "name", "page", "box", "anchor", wrong.alias("wrong")))
    shown = regions.groupBy("run_id", "i").agg(
        F.count("wrong").alias("n_wrong"), F.map_from_entries(F.collect_list(F.when(F.col("wrong").isNull(), F.struct("name", F.struct("page", "box", "anchor"))))).alias("shown")
    )
    has = lambda name: F.coalesce(F.map_contains_key("shown", F.lit(name)), F.lit(False))
    lacking = _found((F.col("is_object") & F.col("has_regions") & ~has("question_prompt"), "question_prompt_missing"), ((F.col("mode") == CASE) & ~has("case_stem"), "case_stem_missing"))
    whole = materialize(rows.drop("regions").join(shown, ["run_id", "i"], "left").withColumn("broken", F.when(F.col("is_object"), F.concat("broken", lacking)).otherwise(F.col("broken"))))
    good = whole.filter((F.size("broken") == 0) & (F.coalesce("n_wrong", F.lit(0)) == 0))

    first = good.groupBy("run_id", "id").agg(F.min("i").alias("first"))
    again = good.join(first, ["run_id", "id"]).filter("i > first")
    urls = good.select("run_id", "i", F.explode("image_urls").alias("output_path"))
    orphans = urls.join(good_assets.select("run_id", "output_path").distinct(), ["run_id", "output_path"], "left_anti")
    blank = (F.col("policy_needs_review") != "") | F.col("policy_type").startswith("blank")
    policies = heads.filter(F.col("policy").isin(*EVIDENCE_POLICIES)).select("run_id")
    silent = good.filter(~blank & ~has("answer_evidence")).join(policies, "run_id", "left_semi")

    parts = [
        heads.select("run_id", F.lit("").alias("place"), F.explode("broken").alias("violation"), detail),
        asset_pages.select("run_id", at("assets").alias("place"), F.explode("broken").alias("violation"), detail),
        whole.select("run_id", at("planned_rows").alias("place"), F.explode("broken").alias("violation"), detail),
        regions.filter("wrong is not null").select("run_id", F.concat(at("planned_rows"), F.lit(".regions."), "name").alias("place"), F.col("wrong").alias("violation"), detail),
        again.select("run_id", at("planned_rows").alias("place"), F.lit("id_repeated").alias("violation"), F.col("id").alias("detail")),
        orphans.select("run_id", at("planned_rows").alias("place"), F.lit("image_without_asset").alias("violation"), F.col("output_path").alias("detail")),
        silent.select("run_id", at("planned_rows").alias("place"), F.lit("answer_evidence_missing").alias("violation"), detail),
    ]
    violations = parts[0]
    for p in parts[1:]:
        violations = violations.unionByName(p)
    violations = materialize(violations)
    bad = violations.select("run_id").distinct()

    counted = good.groupBy("run_id").agg(F.count("*").alias("question_count"))
    there = pages.groupBy("run_id").agg(F.count("*").cast("double").alias("n_rendered"))
    profiles = heads.join(bad, "run_id", "left_anti").join(counted, "run_id", "left").join(there, "run_id", "left").select(
        "run_id", F.coalesce("page_count", "n_rendered", F.lit(0.0)).alias("page_count"), F.coalesce("question_count", F.lit(0)).alias("question_count"), "question_pages", "policy", "answer_key_present", "marking_style", "worker_rule"
    )
    columns = ("id", "topic", "subtopic", "year", "mode", "final_format", "image_urls", "policy_type", "policy_value", "policy_needs_review", *TASKS)
    typed = good.join(bad, "run_id", "left_anti").select("run_id", "i", *columns, *(F.element_at("shown", F.lit(n)).alias(n) for n in REGIONS))
    kept_assets = good_assets.join(bad, "run_id", "left_anti").select("run_id", "i", "asset_id", "kind", "page", "box", "output_path", "linked_row_ids", "anchor")
    return Blueprints(violations, profiles, kept_assets, typed)
