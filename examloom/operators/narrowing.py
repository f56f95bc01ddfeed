"""Raw responses to typed rows (F54, F61-F63, F65, F70, F72, P18): every value is tested for its type before it is read.

``value`` columns are variants, null where a text is no JSON. What is wrong is told in ``errors``, an array of strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examloom.functions import text as tx

#: States of an answer's evidence, and answer policies.
STATES = ("none", "inline", "separate", "ambiguous", "illegible")
POLICIES = ("no_answer_key", "separate_key", "inline_marks", "mixed", "uncertain")
RISKS = ("safe_to_import", "not_safe_to_import")


#: What ``tx.trim`` takes off: white space of patterns, and two characters more.
WHITE = " \t\n\x0b\f\r\u00a0\ufeff"


def parsed(text: Column) -> Column:
    """a response as a variant, null where it is no JSON; one code fence around it falls away, if its marks stand on lines of their own."""
    fence = rf"(?s)^```(?:json)?{tx.WS}*\n(.*?)\n```{tx.WS}*\z"
    bare = let(F.btrim(text, F.lit(WHITE)), lambda body: F.when(body.startswith("```") & body.rlike(fence), F.regexp_extract(body, fence, 1)).otherwise(body))
    # The parser stops behind the first value: as the one element of an array, a value with more text behind it is refused.
    alone = F.try_parse_json(F.concat(F.lit("["), bare, F.lit("]")))
    return let(F.try_variant_get(alone, "$", "array<variant>"), lambda items: F.when(F.size(items) == 1, F.get(items, F.lit(0))))


def read_responses(responses: DataFrame, text: str = "text") -> DataFrame:
    """``responses`` with ``value``; of a key that is repeated in an object, the last one counts.

    Whether repeated keys are an error is a setting of the session, which an expression keeps as it was when it was built; the setting is put back at once.
    """
    conf, name = responses.sparkSession.conf, "spark.sql.variant.allowDuplicateKeys"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return responses.withColumn("value", parsed(F.col(text)))
    finally:
        conf.set(name, before)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once, also within a function of higher order."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kind(value: Column, path: str) -> Column:
    """the type at a path: OBJECT<...>, ARRAY<...>, STRING, BOOLEAN, BIGINT, VOID (a null); null where there is nothing."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def string_at(value: Column, path: str) -> Column:
    return F.when(kind(value, path) == "STRING", F.try_variant_get(value, path, "string"))


def flag_at(value: Column, path: str) -> Column:
    return F.when(kind(value, path) == "BOOLEAN", F.try_variant_get(value, path, "boolean"))


def number_at(value: Column, path: str) -> Column:
    """Any number, as a double."""
    return F.when(kind(value, path).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(value, path, "double"))


def count_at(value: Column, path: str) -> Column:
    """A number as a count: whole, and 0 at least."""
    return let(number_at(value, path), lambda n: F.when(n.isNotNull(), F.greatest(F.floor(n), F.lit(0).cast("bigint"))))


def page_at(value: Column, path: str) -> Column:
    """A positive whole number, whether written as 1 or as 1.0."""
    return let(number_at(value, path), lambda n: F.when((n >= 1) & (n == F.floor(n)), n.cast("bigint")))


def items_at(value: Column, path: str) -> Column:
    """The elements of an array as variants, null where there is none."""
    return F.try_variant_get(value, path, "array<variant>")


def is_record(value: Column, path: str = "$") -> Column:
    """Whether there is an object: nothing else becomes a struct. Its members are not looked at, as ``kind`` would."""
    return F.try_variant_get(value, path, "struct<>").isNotNull()


def strings_at(value: Column, path: str) -> Column:
    """The strings of an array; other elements fall out."""
    return F.filter(F.transform(items_at(value, path), lambda x: string_at(x, "$")), lambda x: x.isNotNull())


def positive_pages(pages: Column, most: Column | None = None) -> Column:
    """the distinct numbers from 1 (up to ``most``) of an array of variants, in order of their first mention."""
    ok = F.filter(F.transform(pages, lambda p: page_at(p, "$")), lambda p: p.isNotNull() & (F.lit(True) if most is None else p <= most))
    return F.array_distinct(ok)


def was_truncated(finish_reason: Column) -> Column:
    """F54."""
    return finish_reason == "MAX_TOKENS"


def _judged(responses: DataFrame, section: str, build: Callable[[Column], Column], complete: Callable[[Column], Column]) -> DataFrame:
    """Adds ``rows``, an array of ``build`` of each element of a section, and ``faults``, the places of incomplete ones; both null without the section."""
    rows = F.transform(items_at(F.col("value"), f"$.{section}"), build)
    df = responses.withColumn(section, rows)
    at = F.filter(F.transform(section, lambda r, i: F.when(~complete(r), i)), lambda i: i.isNotNull())
    return df.withColumn(f"{section}_faults", F.transform(at, lambda i: F.concat(F.lit(f"{section}["), i.cast("string"), F.lit("] is invalid"))))


def index_windows(responses: DataFrame) -> DataFrame:
    """``responses`` with value to ok, errors, questions and pages: one bad element spoils its whole window.

    An old response says ``evidence_state`` instead of answer_present.
    """

    def question(q: Column) -> Column:
        state = string_at(q, "$.evidence_state")
        present = F.coalesce(flag_at(q, "$.answer_present"), F.when(state.isin(*STATES), state == "inline"))
        stem_ok = kind(q, "$.case_stem_key").isin("STRING", "VOID")
        return F.struct(
            string_at(q, "$.ref").alias("ref"), string_at(q, "$.printed_label").alias("printed_label"), page_at(q, "$.owner_page").alias("owner_page"),
            F.array_sort(positive_pages(items_at(q, "$.source_pages"))).alias("source_pages"), string_at(q, "$.anchor").alias("anchor"), flag_at(q, "$.options_present").alias("options_present"),
            string_at(q, "$.case_stem_key").alias("case_stem_key"), string_at(q, "$.section_hint").alias("section_hint"), string_at(q, "$.visible_year").alias("visible_year"),
            present.alias("answer_present"), F.coalesce(stem_ok, F.lit(False)).alias("stem_ok"),
        )

    def page(p: Column) -> Column:
        return F.struct(
            page_at(p, "$.page").alias("page"), flag_at(p, "$.contains_question_start").alias("contains_question_start"), string_at(p, "$.first_printed_label").alias("first_label"),
            string_at(p, "$.last_printed_label").alias("last_label"), string_at(p, "$.section_hint").alias("section_hint"),
        )

    every = lambda r, *names: F.forall(F.array(*(r[n].isNotNull() for n in names)), lambda x: x)
    whole = lambda q: every(q, "ref", "printed_label", "owner_page", "anchor", "options_present", "section_hint", "visible_year", "answer_present") & q["stem_ok"] & (F.coalesce(F.size(q["source_pages"]), F.lit(0)) > 0)
    df = _judged(responses, "questions", question, whole)
    df = _judged(df, "pages", page, lambda p: every(p, "page", "contains_question_start", "first_label", "last_label", "section_hint"))
    missing = F.col("questions").isNull() | F.col("pages").isNull()
    errors = F.when(missing, F.array(F.lit("index response must contain questions and pages arrays"))).otherwise(F.concat("questions_faults", "pages_faults"))
    return df.withColumn("errors", errors).withColumn("ok", F.size("errors") == 0).drop("questions_faults", "pages_faults")


def figure_detections(responses: DataFrame) -> DataFrame:
    """F63, strict: ok, errors and figures (page, refs, anchor)."""

    def figure(f: Column) -> Column:
        return F.struct(page_at(f, "$.page").alias("page"), F.coalesce(strings_at(f, "$.linked_refs"), F.array().cast("array<string>")).alias("refs"), string_at(f, "$.anchor").alias("anchor"))

    df = _judged(responses, "figures", figure, lambda f: f["page"].isNotNull() & f["anchor"].isNotNull() & (F.size(f["refs"]) > 0))
    errors = F.when(F.col("figures").isNull(), F.array(F.lit("figure response must contain figures"))).otherwise(F.col("figures_faults"))
    return df.withColumn("errors", errors).withColumn("ok", F.size("errors") == 0).drop("figures_faults")


def box_at(value: Column, path: str) -> Column:
    """four numbers from 0 to 1000 with a positive extent, [y0, x0, y1, x1]; null for anything else."""

    def boxed(parts: Column) -> Column:
        ok = (F.size(parts) == 4) & F.forall(parts, lambda x: x.isNotNull() & (x >= 0) & (x <= 1000)) & (F.get(parts, F.lit(2)) > F.get(parts, F.lit(0))) & (F.get(parts, F.lit(3)) > F.get(parts, F.lit(1)))
        return F.when(ok, parts)

    return let(F.transform(items_at(value, path), lambda x: number_at(x, "$")), boxed)


def boxed_figures(responses: DataFrame) -> DataFrame:
    """F63, lenient: figures (page, box, refs, anchor) of each response; bad ones are dropped, and a response without the array has null."""

    def figure(f: Column) -> Column:
        return F.struct(page_at(f, "$.page").alias("page"), box_at(f, "$.box_2d").alias("box"), strings_at(f, "$.linked_refs").alias("refs"), string_at(f, "$.anchor").alias("anchor"))

    good = lambda f: f["page"].isNotNull() & f["box"].isNotNull() & f["anchor"].isNotNull() & (F.coalesce(F.size(f["refs"]), F.lit(0)) > 0)
    return responses.withColumn("figures", F.filter(F.transform(items_at(F.col("value"), "$.figures"), figure), good))


def evidence_maps(responses: DataFrame) -> DataFrame:
    """F63, strict: ok, errors, policy and evidence (ref, state)."""
    df = _judged(responses, "evidence", lambda e: F.struct(string_at(e, "$.ref").alias("ref"), string_at(e, "$.state").alias("state")), lambda e: e["ref"].isNotNull() & F.coalesce(e["state"].isin(*STATES), F.lit(False)))
    policy = string_at(F.col("value"), "$.type")
    head = F.coalesce(policy.isin(*POLICIES), F.lit(False)) & string_at(F.col("value"), "$.marking_style").isNotNull() & F.col("evidence").isNotNull()
    errors = F.when(~head, F.array(F.lit("evidence response is invalid"))).otherwise(F.col("evidence_faults"))
    return df.withColumn("policy", policy).withColumn("errors", errors).withColumn("ok", F.size("errors") == 0).drop("evidence_faults")


def audit_reports(responses: DataFrame) -> DataFrame:
    """ok, errors, audit_pass and risk. A report that can't be read has neither: it is never a pass."""
    v = F.col("value")
    tests = (
        (flag_at(v, "$.audit_pass").isNull(), "audit_pass must be a boolean"),
        (~F.coalesce(string_at(v, "$.risk_class").isin(*RISKS), F.lit(False)), "risk_class must be safe_to_import or not_safe_to_import"),
        (items_at(v, "$.failed_rows").isNull(), "failed_rows must be an array"),
        (items_at(v, "$.global_failures").isNull(), "global_failures must be an array"),
    )
    found = F.filter(F.array(*(F.when(bad, F.lit(text)) for bad, text in tests)), lambda x: x.isNotNull())
    errors = F.when(v.isNull(), F.array(F.lit("audit response is not valid JSON"))).when(~is_record(v), F.array(F.lit("audit response must be a JSON object"))).otherwise(found)
    ok = F.size("errors") == 0
    out = responses.withColumn("errors", errors).withColumn("ok", ok)
    return out.withColumn("audit_pass", F.when(F.col("ok"), flag_at(v, "$.audit_pass"))).withColumn("risk", F.when(F.col("ok"), string_at(v, "$.risk_class")))


def declared_counts(responses: DataFrame) -> DataFrame:
    """Declared, planned and under_extracted; a count that is missing never says that rows are."""
    declared, planned = number_at(F.col("value"), "$.document_profile.question_count"), F.size(items_at(F.col("value"), "$.planned_rows"))
    planned = F.when(items_at(F.col("value"), "$.planned_rows").isNotNull(), planned)
    return responses.withColumn("declared", declared).withColumn("planned", planned).withColumn("under_extracted", F.coalesce(F.col("planned") < F.col("declared"), F.lit(False)))


def resolved_questions(responses: DataFrame, rows: DataFrame) -> DataFrame:
    """run_id, ok and questions of each response (run_id, value): one unknown id or malformed entry rejects all. ``rows``: run_id, id."""
    entries = items_at(F.col("value"), "$.resolved")
    each = responses.select("run_id", F.explode(F.transform(entries, lambda e: F.struct(string_at(e, "$.id").alias("id"), string_at(e, "$.question").alias("question")))).alias("e")).select("run_id", "e.*")
    known = each.join(rows.select("run_id", "id", F.lit(True).alias("known")).distinct(), ["run_id", "id"], "left")
    bad = known.groupBy("run_id").agg(F.count_if(F.col("id").isNull() | F.col("question").isNull() | F.col("known").isNull()).alias("bad"), F.count_distinct("id").alias("n"))
    out = responses.select("run_id", entries.isNotNull().alias("listed")).join(bad, "run_id", "left")
    ok = F.col("listed") & (F.coalesce("bad", F.lit(0)) == 0)
    return out.select("run_id", ok.alias("ok"), F.when(ok, F.coalesce("n", F.lit(0))).otherwise(0).alias("questions"))


def quota_rows(stored: DataFrame, model: str) -> DataFrame:
    """(key, day, model, requests) from (key, value): counts by model, or the old single count for ``model``; what can't be read gives no row."""
    v = F.col("value")
    counts = F.when(is_record(v, "$.counts"), F.try_variant_get(v, "$.counts", "map<string, variant>"))
    legacy = F.when(number_at(v, "$.count").isNotNull(), F.create_map(F.lit(model), count_at(v, "$.count")))
    known = F.map_filter(F.transform_values(counts, lambda _, x: count_at(x, "$")), lambda _, n: n.isNotNull())
    day = string_at(v, "$.day")
    return stored.filter(day.isNotNull()).select("key", day.alias("day"), F.explode(F.coalesce(known, legacy)).alias("model", "requests"))
