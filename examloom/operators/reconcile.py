"""Windows over pages, and one list of questions from overlapping observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examloom.functions import text as tx
from examloom.order import ranked_within
from examloom.rounds import first_independent
from examloom.storage import materialize


def planned_windows(pages: DataFrame, size: int, context: int = 1) -> DataFrame:
    """(run_id, page, win, role): cores of ``size`` rendered pages, and the rendered neighbours as context."""
    ranked = ranked_within(pages.select("run_id", "page").distinct(), "run_id", [F.col("page").asc()]).withColumn("rank", F.col("rank").cast("int") - 1)
    core = F.floor(F.col("rank") / size).cast("int")
    near = F.floor((F.col("rank") + F.col("step")) / size).cast("int")
    steps = F.explode(F.array(*(F.lit(s) for s in range(-context, context + 1))))
    last = ranked.groupBy("run_id").agg(F.max(core).alias("last"))
    seen = ranked.join(last, "run_id").withColumn("step", steps).withColumn("win", near).filter((F.col("rank") + F.col("step") >= 0) & (F.col("win") <= F.col("last")))
    return seen.select("run_id", "page", "win", F.when(F.col("win") == core, "core").otherwise("context").alias("role")).distinct()


def chunked(rows: DataFrame, size: int = 10) -> DataFrame:
    """Rows in chunks of a fixed size, in order."""
    return ranked_within(rows, "run_id", [F.col("pos").asc()]).withColumn("chunk", F.floor((F.col("rank") - 1) / size).cast("int")).drop("rank")


def localized(windows: DataFrame, responses: DataFrame) -> DataFrame:
    """Observations with a page relative to their window get the page itself, their ref, and whether the window owns it.

    ``windows``: (run_id, page, win, role); ``responses``: (run_id, win, ordinal, relative_page).
    """
    at = F.row_number().over(Window.partitionBy("run_id", "win").orderBy("page"))
    pages = windows.withColumn("relative_page", at)
    ref = F.concat(F.lit("w"), F.col("win").cast("string"), F.lit("q"), F.col("ordinal").cast("string"))
    return responses.join(pages, ["run_id", "win", "relative_page"]).select("run_id", "win", "ordinal", "page", ref.alias("ref"), (F.col("role") == "core").alias("owned"))


def twin_candidates(seen: DataFrame) -> DataFrame:
    """Pairs of observations from different windows, a page apart at most, with one label or telling anchors of which one starts the other."""
    o = seen.select("run_id", "win", "page", "ref", tx.trim(F.col("label")).alias("label"), tx.squeezed(F.col("anchor")).alias("anchor"), tx.is_generic(F.col("anchor")).alias("generic"))
    b = o.select("run_id", *(F.col(c).alias(f"other_{c}") for c in ("win", "ref", "label", "anchor", "generic")), F.col("page").alias("other_page"))
    a = o.withColumn("other_page", F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)))
    same_label = (F.col("label") != "") & (F.col("label") == F.col("other_label"))
    prefix = F.col("anchor").startswith(F.col("other_anchor")) | F.col("other_anchor").startswith(F.col("anchor"))
    telling = ~F.col("generic") & ~F.col("other_generic") & (F.col("anchor") != "") & prefix
    met = a.join(b, ["run_id", "other_page"]).filter((F.col("win") < F.col("other_win")) & (same_label | telling))
    return met.select("run_id", "ref", "other_ref", F.when(same_label, "duplicate_label").otherwise("duplicate_anchor").alias("rule"))


def reconciled(seen: DataFrame) -> DataFrame:
    """J8, ST9, U1: (run_id, ref, page, rule, twin_ref); rule is ``kept`` or why an observation was dropped. Refs are unique in a run.

    Windows are gone through in order, first what they own and then what they only saw. An observation is dropped if one that was kept before is its
    twin: of another window, at most a page apart, with the same label, or with telling anchors of which one starts the other. What a window only saw is also
    dropped on a page where one of its observations has a twin and it saw no more than was owned there, and if it has no label, no telling anchor and
    the page has owners. All rows whose earlier twins are settled are settled at once, so a run may have any number of them; a page's rows meet each other.
    """
    label, anchor = (rule(F.coalesce(F.col(c), F.lit(""))) for c, rule in (("label", tx.trim), ("anchor", tx.squeezed)))
    o = materialize(seen.select("run_id", "win", "ordinal", "is_core", "page", "ref", label.alias("label"), anchor.alias("anchor"), tx.is_generic(anchor).alias("generic"), F.struct("run_id", "ref").alias("node")))
    e = o.select("run_id", F.col("page").alias("near"), *(F.col(c).alias(f"e_{c}") for c in ("win", "ordinal", "is_core", "ref", "label", "anchor", "generic", "node")))
    near = o.withColumn("near", F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1))).join(e, ["run_id", "near"])
    before = F.when(F.col("is_core"), F.col("e_is_core") & (F.col("e_win") < F.col("win"))).otherwise((F.col("e_is_core") & (F.col("e_win") != F.col("win"))) | (~F.col("e_is_core") & (F.col("e_win") < F.col("win"))))
    same_label = (F.col("label") != "") & (F.col("label") == F.col("e_label"))
    telling = (F.col("anchor") != "") & ~F.col("generic") & ~F.col("e_generic") & (F.col("anchor").startswith(F.col("e_anchor")) | F.col("e_anchor").startswith(F.col("anchor")))
    rule = F.when(same_label, "duplicate_label").otherwise("duplicate_anchor")
    place = F.struct((~F.col("e_is_core")).cast("int"), "e_win", "e_ordinal", "e_ref")
    twins = materialize(near.filter(before & (same_label | telling)).select("node", "is_core", "run_id", "win", "page", F.col("e_node").alias("earlier"), F.col("e_is_core").alias("to_core"), F.struct(place.alias("place"), rule.alias("rule"), F.col("e_ref").alias("ref")).alias("twin")))

    core_dropped = materialize(first_independent(twins.filter("is_core")))
    owned = o.filter("is_core").join(core_dropped, "node", "left_anti").groupBy("run_id", "page").agg(F.count("*").alias("owned"))

    # What a window saw on a page: whether a twin of one of them drops all.
    here = ["run_id", "win", "page"]
    saw = o.filter("not is_core")
    groups = saw.groupBy(*here).agg(F.count("*").alias("reread")).join(owned, ["run_id", "page"], "left").withColumn("closed", F.col("reread") <= F.coalesce("owned", F.lit(0)))
    saw = saw.join(groups.select(*here, "closed", F.col("owned").isNotNull().alias("covered")), here)
    weak = (F.col("label") == "") & F.col("generic") & F.col("covered")
    to_kept_core = twins.filter("not is_core and to_core").join(core_dropped.withColumnRenamed("node", "earlier"), "earlier", "left_anti")
    members = materialize(saw.select("node", *here, "closed", weak.alias("weak")))
    closed = members.filter("closed").select(*here)
    with_mates = lambda some: some.join(closed.distinct(), here, "left_semi").select(*here, "earlier").join(members.filter("closed").select(*here, "node"), here).select("node", "earlier")
    surely = members.filter("weak").select("node").unionByName(to_kept_core.select("node")).unionByName(with_mates(to_kept_core).select("node")).distinct()
    surely = materialize(surely)
    later = twins.filter("not is_core and not to_core")
    edges = later.select("node", "earlier").unionByName(with_mates(later)).join(surely, "node", "left_anti").join(surely.withColumnRenamed("node", "earlier"), "earlier", "left_anti")
    dropped = materialize(core_dropped.unionByName(surely).unionByName(first_independent(edges)))

    kept_twin = twins.join(dropped.withColumnRenamed("node", "earlier"), "earlier", "left_anti").groupBy("node").agg(F.min("twin").alias("twin"))
    # A page is aligned if any of the window's rows there has a kept twin.
    aligned = members.filter("closed").join(kept_twin, "node", "left_semi").select(*here).distinct()
    swept = members.filter("closed").join(aligned, here, "left_semi").select("node", F.lit(True).alias("swept"))
    out = o.select("node", "run_id", "ref", "page").join(dropped.withColumn("gone", F.lit(True)), "node", "left").join(kept_twin, "node", "left").join(swept, "node", "left")
    why = F.when(F.col("gone").isNull(), "kept").when(F.col("twin").isNotNull(), F.col("twin.rule")).when(F.col("swept"), "covered_reread").otherwise("page_not_owned")
    return out.select("run_id", "ref", "page", why.alias("rule"), F.when(F.col("gone"), F.col("twin.ref")).alias("twin_ref"))


def verified_pages(questions: DataFrame, page_text: DataFrame) -> DataFrame:
    """The page of each question after a look for its anchor on its page and both neighbours: one hit confirms or moves it."""
    q = questions.select("run_id", "ref", "page", tx.squeezed(F.col("anchor")).alias("anchor"))
    long = q.filter(F.length("anchor") >= 12).withColumn("near", F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)))
    t = page_text.select("run_id", F.col("page").alias("near"), tx.squeezed(F.col("text")).alias("page_text"))
    hits = long.join(t, ["run_id", "near"]).filter(F.col("page_text").contains(F.col("anchor"))).groupBy("run_id", "ref").agg(F.count("*").alias("hits"), F.min("near").alias("found"))
    one = F.col("hits") == 1
    out = q.join(hits, ["run_id", "ref"], "left")
    return out.select("run_id", "ref", F.when(one, F.col("found")).otherwise(F.col("page")).alias("page"), F.when(~F.coalesce(one, F.lit(False)), "unverified").when(F.col("found") == F.col("page"), "confirmed").otherwise("moved").alias("status"))


def repair_pages(failed: DataFrame, issues: DataFrame, owned: DataFrame, exam: DataFrame) -> DataFrame:
    """(run_id, page) of failed and problem pages of the exam that no window owns."""
    want = failed.select("run_id", "page").union(issues.select("run_id", "page")).distinct()
    return want.join(exam, ["run_id", "page"], "left_semi").join(owned, ["run_id", "page"], "left_anti")


def page_issues(manifest: DataFrame, questions: DataFrame) -> DataFrame:
    """Pages where a question starts and none was kept. The last manifest of a page counts: (run_id, win, page, starts)."""
    last = manifest.groupBy("run_id", "page").agg(F.max_by("starts", "win").alias("starts"))
    return last.filter("starts").join(questions.select("run_id", "page").distinct(), ["run_id", "page"], "left_anti").select("run_id", "page")
