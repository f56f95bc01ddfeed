"""The registered queries, each with its oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examloom.functions import text as tx
from examloom.operators import answers, assembly, geometry, grading, reconcile, review, stitch, store, telemetry, topics
from examloom.plans.oracle_relations import BARE_QUESTION, sql, squeezed, trim
from examloom.sources import relations as rel

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, read when they are asked for, and the relations derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return rel.read(self._spark, self._dir, name)

    @property
    def v1(self) -> DataFrame:
        return rel.exam_rows(self.documents)

    @property
    def v2(self) -> DataFrame:
        return rel.planned_rows(self.v1)

    @property
    def picks(self) -> DataFrame:
        return rel.resolutions(self.labels)

    @property
    def edits(self) -> DataFrame:
        return rel.edits(self.benchmark)

    @property
    def deleted(self) -> DataFrame:
        return rel.deletions(self.labels)

    @property
    def added(self) -> DataFrame:
        return rel.additions(self.conversations)

    @property
    def ai(self) -> DataFrame:
        return rel.ai_answers(self.labels)

    @property
    def reviewed(self) -> DataFrame:
        return review.reviewed(self.v1, self.added, self.deleted, self.edits, self.picks)

    @property
    def log(self) -> DataFrame:
        return rel.log_events(self.events)

    @property
    def seen(self) -> DataFrame:
        # Anchors are a question's first words, so that no more of the texts is read.
        return rel.observations(rel.exam_rows(self.documents.withColumn("text", F.substring_index("text", " ", 6))))

    @property
    def geo(self) -> DataFrame:
        return rel.geometry(self.lineitem)

    @property
    def artifacts(self) -> DataFrame:
        return rel.artifacts(self.lineitem)

    @property
    def runs(self) -> DataFrame:
        return rel.runs(self.orders)

    @property
    def run_pages(self) -> DataFrame:
        r = rel.run_pages(self.orders, self.lineitem)
        step = F.when(F.col("status") == "running", "render").otherwise("worker")
        p = telemetry.run_progress(F.col("status"), step, F.col("pages_rendered"), F.col("page_count"), F.col("pages_rendered"), F.col("page_count"))
        return r.withColumn("progress", p)

    @property
    def validated(self) -> DataFrame:
        picks = rel.topic_picks(self.supplier, self.nation, self.region)
        return topics.validated_matches(picks, picks, rel.topics(self.region, self.nation))

    @property
    def matched(self) -> DataFrame:
        return topics.usable(self.validated)

    @property
    def files(self) -> DataFrame:
        return rel.file_names(self.part)


def query(oracle: str | None = None, *needs: str):
    def register(f: Callable[[Tables], DataFrame]):
        name = f.__name__
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle is not None:
            _ORACLES[name] = sql(oracle, *needs)
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


joined = lambda c: F.array_join(c, "|")


@query(
    """, p AS (SELECT c.run_id, c.pos, c.options, (SELECT max(s.pos) FROM cont s WHERE NOT s.continuation AND s.run_id = c.run_id AND s.page = c.page - 1 AND s.pos < c.pos) AS stem FROM cont c WHERE c.continuation),
    m AS (SELECT run_id, stem AS pos, string_agg(array_to_string(options, '|'), '|' ORDER BY pos) AS more, count(*) AS joined FROM p WHERE stem IS NOT NULL GROUP BY 1, 2)
    SELECT run_id, pos, array_to_string(options, '|') || CASE WHEN more IS NULL THEN '' ELSE '|' || more END AS options, CAST(coalesce(joined, 0) AS INT) AS joined, '' AS reason FROM cont LEFT JOIN m USING (run_id, pos) WHERE NOT continuation
    UNION ALL SELECT run_id, pos, array_to_string(options, '|'), 0, 'orphaned_page_continuation' FROM p WHERE stem IS NULL""",
    "cont",
)
def stitch_continuations(t: Tables) -> DataFrame:
    return stitch.stitched(rel.continuations(t.conversations)).withColumn("options", joined("options"))


def _stems(cont: str) -> str:
    """SQL of ``g`` (run_id, pos, stem): each continuation's stem, followed from continuation to continuation."""
    last = f"(SELECT max(s.pos) FROM {cont} s WHERE {{0}} s.continuation AND s.run_id = c.run_id AND s.page = c.page - 1 AND s.pos < c.pos)"
    return f""", l AS (SELECT run_id, pos, {last.format("NOT")} AS a, {last.format("")} AS n FROM {cont} c WHERE continuation),
    t AS (SELECT run_id, pos, n, a AS best FROM l UNION ALL SELECT t.run_id, t.pos, l.n, greatest(t.best, l.a) FROM t JOIN l ON l.run_id = t.run_id AND l.pos = t.n), g AS (SELECT run_id, pos, max(best) AS stem FROM t GROUP BY 1, 2)"""


@query(
    f"""RECURSIVE{_stems("cont")}, m AS (SELECT run_id, stem AS pos, string_agg(array_to_string(options, '|'), '|' ORDER BY cont.pos) AS more, count(*) AS joined FROM g JOIN cont USING (run_id, pos) WHERE stem IS NOT NULL GROUP BY 1, 2)
    SELECT run_id, pos, array_to_string(options, '|') || CASE WHEN more IS NULL THEN '' ELSE '|' || more END AS options, CAST(coalesce(joined, 0) AS INT) AS joined, '' AS reason FROM cont LEFT JOIN m USING (run_id, pos) WHERE NOT continuation
    UNION ALL SELECT run_id, pos, array_to_string(options, '|'), 0, 'orphaned_page_continuation' FROM g JOIN cont USING (run_id, pos) WHERE stem IS NULL""",
    "cont",
)
def stitch_continuations_exact(t: Tables) -> DataFrame:
    return stitch.stitched_exactly(rel.continuations(t.conversations)).withColumn("options", joined("options"))


_PASSING = "('empty_question', 'incomplete_options', 'no_visible_answer', 'options_cut_at_page_break')"


@query(
    f"""RECURSIVE{_stems("chained")}, m AS (SELECT g.run_id, stem AS pos, list(struct_pack(o := options, c := correct_index, r := needs_review) ORDER BY g.pos) AS more FROM g JOIN chained USING (run_id, pos) WHERE stem IS NOT NULL GROUP BY 1, 2),
    f AS (SELECT run_id, pos, coalesce(len(more), 0) AS joined, list_reduce(list_prepend(struct_pack(o := options, c := correct_index, r := needs_review), coalesce(more, [])), lambda a, b: struct_pack(o := list_concat(a.o, b.o),
        c := CASE WHEN a.c <> '' THEN a.c WHEN b.c = '' THEN '' ELSE CAST(len(a.o) + CAST(b.c AS INT) AS VARCHAR) END,
        r := CASE WHEN a.r NOT IN {_PASSING} THEN a.r WHEN b.r NOT IN {_PASSING} THEN b.r WHEN a.c = '' AND b.c = '' THEN 'no_visible_answer' ELSE '' END)) AS x FROM chained LEFT JOIN m USING (run_id, pos) WHERE NOT continuation)
    SELECT run_id, pos, array_to_string(x.o, '|') AS options, x.c AS correct_index, x.r AS needs_review, CAST(joined AS INT) AS joined FROM f
    UNION ALL SELECT run_id, pos, array_to_string(options, '|'), correct_index, CASE WHEN needs_review = '' THEN 'orphaned_page_continuation' ELSE needs_review END, 0 FROM g JOIN chained USING (run_id, pos) WHERE stem IS NULL""",
    "chained",
)
def stitched_rows(t: Tables) -> DataFrame:
    return stitch.stitched_rows(rel.chained_continuations(t.conversations)).withColumn("options", joined("options"))


_OPTION = trim(r"regexp_replace(" + trim("o") + r", '^[A-Za-z][.)\-:]\s*', '')")


@query(
    f""", c AS (SELECT *, list_filter(list_transform(options, lambda o: {_OPTION}), lambda o: o <> '') AS clean, {trim("question")} AS q, trim(correct_index) AS g FROM exam_rows),
    d AS (SELECT *, g = '' OR coalesce(regexp_full_match(g, '[0-9]+') AND TRY_CAST(g AS INT) < len(clean), false) AS ok FROM c)
    SELECT id, array_to_string(clean, '|') AS options, CASE WHEN ok THEN g ELSE '' END AS correct_index,
    CASE WHEN needs_review <> '' THEN needs_review WHEN q = '' THEN 'empty_question' WHEN len(clean) < 2 THEN 'incomplete_options' WHEN NOT ok THEN 'index_out_of_range' WHEN g = '' THEN 'no_visible_answer' ELSE '' END AS needs_review FROM d""",
    "exam_rows",
)
def parse_rows_flags(t: Tables) -> DataFrame:
    return answers.parsed_rows(t.v1).select("id", joined("options").alias("options"), "correct_index", "needs_review")


_SCORE = "length(question) + length(array_to_string(options, '')) + CASE WHEN correct_index = '' THEN 0 ELSE 1000000 END"
_CONTENT = squeezed("question") + " || chr(1) || array_to_string(list_transform(options, lambda o: " + squeezed("o") + "), chr(1))"


@query(f"SELECT arg_max(id, s * 10000000 - doc_id) AS id, CAST(max(s) AS INT) AS score, count(*) AS copies FROM (SELECT *, {_SCORE} AS s, {_CONTENT} AS k FROM exam_rows) GROUP BY k", "exam_rows")
def dedupe_by_content(t: Tables) -> DataFrame:
    rows = t.v1.withColumn("key", tx.content_key(F.col("question"), F.col("options"))).withColumn("pos", F.col("doc_id"))
    return stitch.best_of(rows, "key").select("id", "score", "copies")


@query(f"SELECT run_id, label, arg_max(id, s * 10000000 - doc_id) AS id, CAST(max(s) AS INT) AS score, count(*) AS copies FROM (SELECT *, {_SCORE} AS s, CAST(pos % 40 AS VARCHAR) AS label FROM exam_rows) GROUP BY 1, 2", "exam_rows")
def dedupe_by_label(t: Tables) -> DataFrame:
    rows = t.v1.withColumn("label", (F.col("pos") % 40).cast("string")).withColumn("pos", F.col("doc_id"))
    return stitch.best_of(rows, "run_id", "label")


@query(
    f"""RECURSIVE, r AS (SELECT run_id, pos, CASE WHEN pos % 7 = 0 THEN 'row-' || CAST(row_number() OVER (PARTITION BY run_id ORDER BY pos) AS VARCHAR) ELSE CAST(pos % 40 AS VARCHAR) END AS label, {_CONTENT} AS k, CAST({_SCORE} AS INT) AS s FROM exam_rows),
    p AS (SELECT run_id, pos, label, lag(label) OVER (PARTITION BY run_id, k ORDER BY pos) AS next FROM r), l AS (SELECT run_id, label, min(pos) AS pos FROM p GROUP BY 1, 2),
    n AS (SELECT l.run_id, l.label, p.next FROM l JOIN p ON p.run_id = l.run_id AND p.pos = l.pos), t AS (SELECT run_id, label, label AS root FROM n WHERE next IS NULL UNION ALL SELECT n.run_id, n.label, t.root FROM n JOIN t ON t.run_id = n.run_id AND t.label = n.next)
    SELECT run_id, pos, label AS id, s AS score FROM (SELECT r.*, row_number() OVER (PARTITION BY r.run_id, root ORDER BY s DESC, pos) AS rn FROM r JOIN t USING (run_id, label)) WHERE rn = 1""",
    "exam_rows",
)
def dedupe_keep_best(t: Tables) -> DataFrame:
    return stitch.deduped(t.v1.withColumn("label", F.when(F.col("pos") % 7 == 0, "").otherwise((F.col("pos") % 40).cast("string"))))


@query(
    """, u AS (SELECT e.id, e.correct_index, pick, coalesce(trim(correct_index) = '' AND pick < len(options), false) AS from_key FROM exam_rows e LEFT JOIN picks USING (doc_id))
    SELECT id, CASE WHEN from_key THEN CAST(pick AS VARCHAR) ELSE correct_index END AS correct_index, from_key FROM u""",
    "exam_rows",
    "picks",
)
def attach_key_answers(t: Tables) -> DataFrame:
    return answers.attach_key(t.v1, t.picks).select("id", "correct_index", "from_key")


@query(
    f"""SELECT run_id, id, CASE WHEN {trim(BARE_QUESTION)} = '' THEN question ELSE {BARE_QUESTION} END AS question, CASE WHEN len(options) >= 2 AND why = '' THEN CAST(CAST(a AS INT) AS VARCHAR) ELSE '' END AS correct_index,
    CASE WHEN len(options) < 2 THEN 'not_mcq' ELSE why END AS needs_review FROM forced""",
    "forced",
)
def merge_force_answer(t: Tables) -> DataFrame:
    return answers.merged_rows(t.v2, t.v1).select("run_id", "id", "question", "correct_index", "needs_review")


@query(
    """, w AS (SELECT run_id, id FROM exam_rows WHERE doc_id % 17 <> 0 UNION ALL SELECT run_id, id FROM exam_rows WHERE doc_id % 23 = 0 AND doc_id % 17 <> 0), c AS (SELECT run_id, id, count(*) AS n FROM w GROUP BY 1, 2)
    SELECT run_id, id, 'duplicate' AS violation FROM c WHERE n > 1 UNION ALL SELECT run_id, id, 'unknown' FROM c ANTI JOIN planned USING (run_id, id) UNION ALL SELECT run_id, id, 'missing' FROM planned ANTI JOIN c USING (run_id, id)""",
    "planned",
)
def merge_violations(t: Tables) -> DataFrame:
    worker = t.v1.filter("doc_id % 17 <> 0")
    return answers.merge_violations(t.v2, worker.unionByName(worker.filter("doc_id % 23 = 0")))


@query(
    """, r AS (SELECT e.*, p.id IS NOT NULL AS known, image_url <> '' AND doc_id % 20 <> 0 AS lost, TRY_CAST(CASE WHEN regexp_full_match(correct_index, '[0-9]+') THEN correct_index END AS INT) AS i FROM exam_rows e LEFT JOIN (SELECT run_id, id FROM planned) p USING (run_id, id))
    SELECT run_id, id, 'not_planned' AS violation FROM r WHERE NOT known UNION ALL SELECT run_id, id, 'empty_question' FROM r WHERE known AND needs_review = '' AND trim(question) = ''
    UNION ALL SELECT run_id, id, 'no_options' FROM r WHERE known AND needs_review = '' AND len(options) = 0 UNION ALL SELECT run_id, id, 'not_a_number' FROM r WHERE known AND correct_index <> '' AND i IS NULL
    UNION ALL SELECT run_id, id, 'out_of_range' FROM r WHERE known AND i >= len(options) UNION ALL SELECT run_id, id, 'missing_crop' FROM r WHERE known AND image_url <> '' AND NOT EXISTS (SELECT 1 FROM exam_rows x WHERE x.run_id = r.run_id AND x.image_url = r.image_url AND x.doc_id % 20 = 0)""",
    "exam_rows",
    "planned",
)
def final_row_violations(t: Tables) -> DataFrame:
    rows = t.v1
    return answers.final_violations(rows, t.v2, rows.filter("doc_id % 20 = 0 and image_url <> ''"))


_FLAGS = """CASE WHEN len(options) < 2 THEN 'incomplete_options' WHEN pos % 5 = 4 THEN 'options_cut_at_page_break' WHEN needs_review <> '' THEN needs_review WHEN trim(question) = '' THEN 'empty_question'
 WHEN doc_id % 5 = 0 AND list_bool_and(list_transform(options, lambda o: regexp_full_match(o, '[a-z]+'))) THEN 'possible_merge' ELSE '' END"""


@query(
    f""", m AS (SELECT *, len(options) >= 2 AND coalesce(list_bool_and(list_transform(options, lambda o: length(o) > 0 AND NOT regexp_matches(o, '^\\s'))), false) AS plain FROM exam_rows)
    SELECT id, array_to_string(options, '|') AS options, {_FLAGS} AS needs_review FROM m WHERE plain AND doc_id % 5 <> 4""",
    "exam_rows",
)
def final_flag_precedence(t: Tables) -> DataFrame:
    # Options that are blank or start with white space would take part of their label's separator along.
    plain = t.v1.filter("doc_id % 5 <> 4 and size(options) >= 2").filter(F.forall("options", lambda o: (F.length(o) > 0) & ~o.rlike(r"^\s")))
    epithets = F.forall("options", lambda o: o.rlike("^[a-z]+$"))
    flagged = answers.final_flags(rel.labelled_options(plain.withColumn("ambiguous", (F.col("doc_id") % 5 == 0) & epithets).withColumn("plain_options", F.col("options"))), F.col("pos") % 5 == 4)
    shown = F.when(F.col("ambiguous"), F.col("plain_options")).otherwise(F.col("options"))
    return flagged.select("id", joined(shown).alias("options"), "needs_review")


@query()
def final_flags_all_rows(t: Tables) -> DataFrame:
    """final_flag_precedence without its oracle's filter: short lists, unlabelled options and blank ones are judged, too."""
    return answers.final_flags(rel.labelled_options(t.v1), F.col("pos") % 5 == 4).select("id", joined("options").alias("options"), "needs_review")


@query("SELECT run_id, CAST(mode AS INT) AS mode FROM modes", "modes")
def modal_option_count(t: Tables) -> DataFrame:
    return answers.modal_option_count(t.v1)


@query("SELECT run_id, id, CAST(len(options) AS INT) AS n_options FROM exam_rows JOIN modes USING (run_id) WHERE len(options) < 2 OR (pos % 5 = 4 AND len(options) < mode)", "modes")
def under_transcribed(t: Tables) -> DataFrame:
    rows = t.v1
    return answers.under_transcribed(rows, rows.filter("pos % 5 = 4"))


@query(
    """, r AS (SELECT *, trim(a) = '' AS blank FROM forced WHERE policy IN ('inline_marks', 'mixed'))
    SELECT run_id, id, page FROM r WHERE blank AND len(options) >= 2 AND reason = '' AND EXISTS (SELECT 1 FROM r x WHERE x.run_id = r.run_id AND x.page = r.page AND NOT x.blank)""",
    "forced",
)
def missed_inline_answers(t: Tables) -> DataFrame:
    return answers.missed_inline(t.v2, t.v1)


@query("SELECT run_id, id, category FROM category WHERE flagged", "category")
def flag_category(t: Tables) -> DataFrame:
    return t.v1.filter(review.is_flagged()).select("run_id", "id", review.flag_category(F.col("needs_review"), F.col("correct_index")).alias("category"))


@query("SELECT run_id, id FROM resolved WHERE (correct_index = '' OR needs_review <> '') AND NOT resolved", "resolved")
def needs_review_rows(t: Tables) -> DataFrame:
    return review.resolved(t.v1, t.picks).filter(review.is_flagged() & ~F.col("resolved")).select("run_id", "id")


@query("SELECT run_id, id FROM exam_rows WHERE contains(lower(question), 'ation') OR len(list_filter(options, lambda o: contains(lower(o), 'ation'))) > 0", "exam_rows")
def search_rows(t: Tables) -> DataFrame:
    return review.matches(t.v1, " Ation ").select("run_id", "id")


@query("SELECT id, correct_index, needs_review FROM resolved", "resolved")
def apply_resolutions(t: Tables) -> DataFrame:
    return review.resolved(t.v1, t.picks).select("id", "correct_index", "needs_review")


@query("SELECT id, coalesce(new_question, question) AS question FROM exam_rows LEFT JOIN edits USING (doc_id)", "exam_rows", "edits")
def apply_content_edits(t: Tables) -> DataFrame:
    return review.edited(t.v1, t.edits).select("id", "question")


@query("SELECT id, coalesce(new_topic, '') AS topic FROM exam_rows LEFT JOIN edits USING (doc_id)", "exam_rows", "edits")
def apply_meta_edits(t: Tables) -> DataFrame:
    return review.edited_meta(t.v1, t.edits).select("id", "topic")


@query("SELECT id FROM exam_rows ANTI JOIN deleted USING (doc_id)", "exam_rows", "deleted")
def apply_deletions(t: Tables) -> DataFrame:
    return review.without_deleted(t.v1, t.deleted).select("id")


@query(
    """SELECT b.run_id, b.id, CAST(row_number() OVER (PARTITION BY b.run_id ORDER BY b.pos, b.id) AS INT) AS question_number, p.page, CASE WHEN b.correct_index = '' OR b.needs_review <> '' THEN coalesce(c.category, 'blank-answer') END AS category
    FROM based b LEFT JOIN (SELECT run_id, id, page FROM planned) p ON p.run_id = b.run_id AND p.id = b.id LEFT JOIN category c ON c.doc_id = b.doc_id""",
    "based",
    "planned",
    "category",
)
def review_rows(t: Tables) -> DataFrame:
    return review.review_rows(t.v1, t.v2, t.added, t.deleted, t.edits).select("run_id", "id", "question_number", "page", "category")


_OWN = "CASE WHEN regexp_full_match(correct_index, '[0-9]+') AND TRY_CAST(correct_index AS INT) < len(options) THEN TRY_CAST(correct_index AS INT) END"


@query(
    f""", a AS (SELECT id, CASE WHEN pick < len(options) THEN pick END AS p, {_OWN} AS o, CASE WHEN ai < len(options) THEN ai END AS m FROM exam_rows LEFT JOIN picks USING (doc_id) LEFT JOIN ai USING (doc_id))
    SELECT id, CASE WHEN p IS NOT NULL THEN 'human' WHEN o IS NOT NULL THEN 'extracted' WHEN m IS NOT NULL THEN 'ai' ELSE 'none' END AS source, CAST(coalesce(p, o, m) AS INT) AS answer FROM a""",
    "exam_rows",
    "picks",
    "ai",
)
def answer_source(t: Tables) -> DataFrame:
    return review.answer_source(t.v1, t.picks, t.ai).select("id", "source", F.col("answer").cast("int").alias("answer"))


@query(
    f""", a AS (SELECT run_id, coalesce(ai < len(options), false) AND confidence <> 'unsure' AS sure, coalesce(CASE WHEN pick < len(options) THEN pick END, {_OWN}) AS cur, ai FROM exam_rows JOIN ai USING (doc_id) LEFT JOIN picks USING (doc_id))
    SELECT run_id, count(*) FILTER (sure AND cur IS NULL) AS n_fill, count(*) FILTER (sure AND cur <> ai) AS n_differ, count(*) FILTER (sure AND cur = ai) AS n_agree, count(*) FILTER (NOT sure) AS n_unsure FROM a GROUP BY 1""",
    "exam_rows",
    "picks",
    "ai",
)
def ai_apply_plan(t: Tables) -> DataFrame:
    return review.ai_plan(t.v1, t.picks, t.ai)


@query("SELECT run_id, count(*) FILTER (correct_index = '' OR needs_review <> '') AS unresolved, count(*) AS n_rows FROM reviewed GROUP BY 1", "reviewed")
def unresolved_counts(t: Tables) -> DataFrame:
    return t.reviewed.groupBy("run_id").agg(F.count_if(review.is_flagged()).alias("unresolved"), F.count("*").alias("n_rows"))


@query("SELECT count(*) FILTER (correct_index = '' OR needs_review <> '') AS unexported FROM reviewed", "reviewed")
def unexported_flagged(t: Tables) -> DataFrame:
    return t.reviewed.agg(F.count_if(review.is_flagged()).alias("unexported"))


_EXPORT = """ex AS (SELECT r.run_id, r.id, coalesce(new_topic, m.topic, '') AS topic, coalesce(m.subtopic, '') AS subtopic, year, 'file ' || r.run_id AS source, question, CAST(to_json(options) AS VARCHAR) AS options, correct_index,
 CASE WHEN image_url = '' THEN '[]' ELSE CAST(to_json([image_url]) AS VARCHAR) END AS image_url FROM reviewed r LEFT JOIN matched m USING (doc_id) LEFT JOIN edits e USING (doc_id) WHERE correct_index <> '' AND needs_review = '')"""
_COLUMNS = ["topic", "subtopic", "year", "source", "question", "options", "correct_index", "image_url"]


def _exported(t: Tables) -> DataFrame:
    return review.export_rows(t.reviewed, t.matched, t.edits, F.concat(F.lit("file "), F.col("run_id")))


@query(f", {_EXPORT} SELECT * FROM ex", "reviewed", "matched", "edits")
def export_projection(t: Tables) -> DataFrame:
    return _exported(t).drop("pos")


def _csv(c: str) -> str:
    return f"""CASE WHEN regexp_matches({c}, '[",\\r\\n]') THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END"""


@query(f", {_EXPORT} SELECT run_id, id, concat_ws(',', {', '.join(map(_csv, _COLUMNS))}) AS line FROM ex", "reviewed", "matched", "edits")
def export_csv_lines(t: Tables) -> DataFrame:
    return review.csv_lines(_exported(t), _COLUMNS).drop("pos")


_SAFE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(file_name, '\.pdf$', '', 'i'), '[\\/:*?"<>|]', '-', 'g'), '\p{Cc}', '', 'g'), '\s+', ' ', 'g'), '^[\s.]+|[\s.]+$', '', 'g')"""


@query(
    f""", b AS (SELECT seq, CASE WHEN {_SAFE} = '' OR NOT regexp_matches({_SAFE}, '[\\p{{L}}\\p{{N}}]') THEN 'exam' ELSE {_SAFE} END AS base FROM files), n AS (SELECT *, row_number() OVER (PARTITION BY lower(base) ORDER BY seq) AS k FROM b)
    SELECT seq, CASE WHEN k = 1 THEN base ELSE base || '-' || CAST(k AS VARCHAR) END AS name FROM n""",
    "files",
)
def bundle_names(t: Tables) -> DataFrame:
    return review.bundle_names(t.files).select("seq", "name")


@query()
def bundle_names_exact(t: Tables) -> DataFrame:
    return review.bundle_names_exactly(t.files.withColumn("batch", F.floor(F.col("seq") / 100)), "batch")


@query("SELECT row_id, topic, subtopic, status FROM validated", "validated")
def topic_match_validation(t: Tables) -> DataFrame:
    return t.validated


@query("SELECT id, coalesce(topic, '') AS topic, coalesce(subtopic, '') AS subtopic FROM exam_rows LEFT JOIN matched USING (doc_id)", "exam_rows", "matched")
def apply_topic_matches(t: Tables) -> DataFrame:
    return topics.with_topics(t.v1, t.matched).select("id", "topic", "subtopic")


@query("SELECT run_id, count(*) AS pending FROM exam_rows ANTI JOIN matched USING (doc_id) GROUP BY 1", "exam_rows", "matched")
def pending_topics(t: Tables) -> DataFrame:
    return topics.pending(t.v1, t.matched).groupBy("run_id").agg(F.count("*").alias("pending"))


_BLANKS = squeezed("x")


@query(
    f""", s AS (SELECT *, doc_id % 3 = 0 AND len(options) >= 2 AND list_bool_and(list_transform(list_slice(options, 1, 3), lambda x: {_BLANKS} <> '' AND contains({squeezed("question || ' ' || array_to_string(options, ' ')")}, {_BLANKS}))) AND list_bool_and(list_transform(options, lambda x: {_BLANKS} <> '' AND contains({squeezed("question || ' ' || array_to_string(options, ' ')")}, {_BLANKS}))) AS split FROM exam_rows)
    SELECT id, CAST(0 AS INT) AS part, question, needs_review FROM s WHERE NOT coalesce(split, false) UNION ALL
    SELECT id || '~m' || CAST(i AS VARCHAR), CAST(i AS INT), 'Match: ' || options[i], CASE WHEN needs_review <> '' THEN needs_review ELSE 'matching_split' END FROM s, unnest(range(1, least(len(options), 3) + 1)) AS u(i) WHERE split""",
    "exam_rows",
)
def matching_split(t: Tables) -> DataFrame:
    rows = t.v1
    splits = rows.filter("doc_id % 3 = 0").select("run_id", "id", F.slice("options", 1, 3).alias("items"), F.col("options").alias("choices"))
    return topics.split_rows(rows, splits).select("id", "part", "question", "needs_review")


_WINDOWS = """, pg AS (SELECT DISTINCT run_id, page FROM planned), rk AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY page) - 1 AS r FROM pg),
 wins AS (SELECT DISTINCT a.run_id, b.page, CAST(a.r // 4 AS INT) AS win, CASE WHEN a.r // 4 = b.r // 4 THEN 'core' ELSE 'context' END AS role FROM rk a JOIN rk b ON a.run_id = b.run_id AND abs(a.r - b.r) <= 1)"""


@query(f"{_WINDOWS} SELECT * FROM wins", "planned")
def plan_windows(t: Tables) -> DataFrame:
    return reconcile.planned_windows(t.v2, 4)


@query("SELECT id, CAST((row_number() OVER (PARTITION BY run_id ORDER BY pos) - 1) // 10 AS INT) AS chunk FROM planned", "planned")
def chunk_rows(t: Tables) -> DataFrame:
    return reconcile.chunked(t.v2).select("id", "chunk")


@query(
    f"""{_WINDOWS}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id, win ORDER BY page) AS rp FROM wins)
    SELECT r.run_id, r.win, CAST(r.ordinal AS INT) AS ordinal, n.page, 'w' || CAST(r.win AS VARCHAR) || 'q' || CAST(r.ordinal AS VARCHAR) AS ref, role = 'core' AS owned FROM (SELECT run_id, CAST(pos // 10 AS INT) AS win, pos % 10 AS ordinal, pos % 5 + 1 AS rp FROM planned) r JOIN n ON n.run_id = r.run_id AND n.win = r.win AND n.rp = r.rp""",
    "planned",
)
def localize_windows(t: Tables) -> DataFrame:
    responses = t.v2.select("run_id", F.floor(F.col("pos") / 10).cast("int").alias("win"), (F.col("pos") % 10).cast("int").alias("ordinal"), (F.col("pos") % 5 + 1).alias("relative_page"))
    return reconcile.localized(reconcile.planned_windows(t.v2, 4), responses)


_GENERIC = " OR ".join(f"starts_with(an, '{g}')" for g in tx.GENERIC_OPENINGS)


@query(
    f""", o AS (SELECT *, length(an) < 12 OR {_GENERIC} AS gen FROM (SELECT *, {squeezed("anchor")} AS an FROM obs))
    SELECT a.run_id, a.ref, b.ref AS other_ref, CASE WHEN a.label <> '' AND a.label = b.label THEN 'duplicate_label' ELSE 'duplicate_anchor' END AS rule FROM o a JOIN o b ON a.run_id = b.run_id AND a.win < b.win AND abs(a.page - b.page) <= 1
    WHERE (a.label <> '' AND a.label = b.label) OR (NOT a.gen AND NOT b.gen AND a.an <> '' AND (starts_with(a.an, b.an) OR starts_with(b.an, a.an)))""",
    "obs",
)
def twin_candidates(t: Tables) -> DataFrame:
    return reconcile.twin_candidates(t.seen)


_TWIN = """k.win <> {j}.win AND abs(k.page - {j}.page) <= 1 AND (({j}.label <> '' AND k.label = {j}.label) OR ({j}.an <> '' AND NOT k.gen AND NOT {j}.gen AND (starts_with(k.an, {j}.an) OR starts_with({j}.an, k.an))))"""
_SEEN = "struct_pack(ref := ref, win := win, page := page, label := label, an := an, gen := gen, core := is_core)"


@query(
    f"""RECURSIVE, o AS (SELECT *, {_SEEN} AS x, row_number() OVER (PARTITION BY run_id ORDER BY is_core DESC, win, ordinal) AS i FROM (SELECT *, length(an) < 12 OR {_GENERIC} AS gen FROM (SELECT *, {squeezed("anchor")} AS an FROM obs))),
    m AS (SELECT run_id, win, page, list(x) AS mates FROM o WHERE NOT is_core GROUP BY 1, 2, 3), j AS (SELECT o.run_id, o.i, o.x, CASE WHEN is_core THEN [] ELSE coalesce(mates, []) END AS mates FROM o LEFT JOIN m USING (run_id, win, page)),
    w AS (SELECT DISTINCT run_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS ref, CAST(NULL AS INT) AS page, '' AS rule, CAST(NULL AS VARCHAR) AS twin_ref, list_filter([x], lambda y: false) AS kept FROM o WHERE i = 1
        UNION ALL SELECT run_id, i, x.ref, x.page, rule, CASE WHEN rule <> 'kept' THEN tw.ref END, CASE WHEN rule = 'kept' THEN list_append(kept, x) ELSE kept END FROM (
        SELECT run_id, i, x, kept, tw, CASE WHEN tw IS NOT NULL THEN CASE WHEN x.label <> '' AND tw.label = x.label THEN 'duplicate_label' ELSE 'duplicate_anchor' END WHEN x.core THEN 'kept' WHEN aligned AND len(mates) <= owned THEN 'covered_reread'
            WHEN x.label = '' AND x.gen AND owned > 0 THEN 'page_not_owned' ELSE 'kept' END AS rule FROM (
        SELECT j.run_id, j.i, j.x, j.mates, w.kept, list_filter(w.kept, lambda k: {_TWIN.format(j="j.x")})[1] AS tw, len(list_filter(w.kept, lambda k: k.core AND k.page = j.x.page)) AS owned,
            len(list_filter(j.mates, lambda q: len(list_filter(w.kept, lambda k: {_TWIN.format(j="q")})) > 0)) > 0 AS aligned FROM w JOIN j ON j.run_id = w.run_id AND j.i = w.i + 1)))
    SELECT run_id, ref, page, rule, twin_ref FROM w WHERE i > 0""",
    "obs",
)
def reconcile_windows(t: Tables) -> DataFrame:
    return reconcile.reconciled(t.seen)


@query(
    f""", q AS (SELECT run_id, ref, page, {squeezed("anchor")} AS an FROM obs WHERE is_core), pt AS (SELECT run_id, CAST(pos // 3 + 1 + CASE WHEN run_id IN ('src1', 'src2') THEN 1 ELSE 0 END AS INT) AS page, {squeezed("string_agg(question, ' ' ORDER BY pos)")} AS tx FROM exam_rows GROUP BY 1, 2),
    h AS (SELECT q.run_id, q.ref, count(*) AS hits, min(pt.page) AS found FROM q JOIN pt ON q.run_id = pt.run_id AND abs(q.page - pt.page) <= 1 AND contains(pt.tx, q.an) WHERE length(an) >= 12 GROUP BY 1, 2)
    SELECT run_id, ref, CASE WHEN hits = 1 THEN found ELSE page END AS page, CASE WHEN hits IS NULL OR hits <> 1 THEN 'unverified' WHEN found = page THEN 'confirmed' ELSE 'moved' END AS status FROM q LEFT JOIN h USING (run_id, ref)""",
    "obs",
)
def verify_owner_pages(t: Tables) -> DataFrame:
    page = (F.floor(F.col("pos") / 3) + 1 + F.when(F.col("run_id").isin("src1", "src2"), 1).otherwise(0)).cast("int")
    text = t.v1.groupBy("run_id", page.alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "question"))), lambda x: x["question"]), " ").alias("text"))
    return reconcile.verified_pages(t.seen.filter("is_core"), text)


@query(
    """, o AS (SELECT DISTINCT run_id, page FROM obs WHERE is_core AND page % 4 <> 0), w AS (SELECT run_id, page FROM obs WHERE win % 3 = 0 UNION SELECT run_id, page FROM obs WHERE page % 5 = 0)
    SELECT run_id, page FROM w SEMI JOIN (SELECT run_id, page FROM planned) p USING (run_id, page) ANTI JOIN o USING (run_id, page)""",
    "obs",
    "planned",
)
def repair_target_pages(t: Tables) -> DataFrame:
    seen = t.seen
    return reconcile.repair_pages(seen.filter("win % 3 = 0"), seen.filter("page % 5 = 0"), seen.filter("is_core and page % 4 <> 0"), t.v2)


@query(
    """, m AS (SELECT run_id, page, arg_max(s, win) AS s FROM (SELECT run_id, win, page, bool_or(label <> '') AS s FROM obs GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT run_id, page FROM m ANTI JOIN (SELECT run_id, page FROM obs WHERE is_core AND page % 4 <> 0) k USING (run_id, page) WHERE s""",
    "obs",
)
def page_issues(t: Tables) -> DataFrame:
    seen = t.seen
    manifest = seen.groupBy("run_id", "win", "page").agg(F.bool_or(F.col("label") != "").alias("starts"))
    return reconcile.page_issues(manifest, seen.filter("is_core and page % 4 <> 0"))


@query("SELECT run_id, row_id, next_top FROM next_tops", "next_tops")
def next_question_top(t: Tables) -> DataFrame:
    return geometry.next_tops(t.geo).select("run_id", "row_id", "next_top")


@query(", l AS (SELECT run_id, max(page) AS last FROM geo GROUP BY 1) SELECT run_id, row_id, page FROM next_tops JOIN l USING (run_id) WHERE next_top IS NULL AND page < last", "next_tops")
def page_boundary_rows(t: Tables) -> DataFrame:
    return geometry.page_boundary(t.geo)


@query("SELECT run_id, row_id, oy0, least(ox0, px0) AS ox0, greatest(oy1, least(coalesce(next_top, 975.0::DOUBLE), 975.0::DOUBLE)) AS oy1, greatest(ox1, px1) AS ox1 FROM next_tops", "next_tops")
def extend_option_boxes(t: Tables) -> DataFrame:
    return geometry.extended_options(t.geo)


@query(
    """, l AS (SELECT run_id, max(page) AS last FROM geo GROUP BY 1), n AS (SELECT run_id, page - 1 AS page, min(py0) AS top FROM geo GROUP BY 1, 2)
    SELECT run_id, row_id, CAST(page + 1 AS INT) AS page, CASE WHEN top IS NULL THEN 1000.0::DOUBLE ELSE least(1000.0::DOUBLE, greatest(250.0::DOUBLE, top + 30)) END AS bottom FROM geo JOIN l USING (run_id) LEFT JOIN n USING (run_id, page) WHERE page < last""",
    "geo",
)
def continuation_strip(t: Tables) -> DataFrame:
    return geometry.continuation_strips(t.geo)


_CROP = """, c AS (SELECT run_id, row_id, greatest(0, floor(ox0 / 1000 * 1654)) AS l, greatest(0, floor(oy0 / 1000 * 2339)) AS t, least(1654, ceil(ox1 / 1000 * 1654)) AS r, least(2339, ceil(oy1 / 1000 * 2339)) AS b FROM geo)"""


@query(f'{_CROP} SELECT run_id, row_id, CAST(l AS BIGINT) AS "left", CAST(t AS BIGINT) AS top, CAST(r - l AS BIGINT) AS width, CAST(b - t AS BIGINT) AS height FROM c WHERE r > l AND b > t', "geo")
def crop_boxes(t: Tables) -> DataFrame:
    c = geometry.crop_box(F.col("oy0"), F.col("ox0"), F.col("oy1"), F.col("ox1"), 1654, 2339)
    return t.geo.select("run_id", "row_id", c.alias("c")).filter("c is not null").select("run_id", "row_id", *(F.col(f"c.{k}").cast("long").alias(k) for k in ("left", "top", "width", "height")))


@query("SELECT run_id, row_id, greatest(0.0::DOUBLE, least(py0, oy0) - 30) AS y0, greatest(0.0::DOUBLE, least(px0, ox0) - 30) AS x0, least(1000.0::DOUBLE, greatest(py1, oy1) + 30) AS y1, least(1000.0::DOUBLE, greatest(px1, ox1) + 30) AS x1 FROM geo", "geo")
def region_union(t: Tables) -> DataFrame:
    return geometry.region_union(t.geo)


@query("SELECT run_id, kind, path, copies FROM art WHERE rn = 1", "art")
def artifact_first(t: Tables) -> DataFrame:
    return store.first_artifacts(t.artifacts)


@query("SELECT run_id, kind, path, copies FROM art WHERE rn = copies", "art")
def artifact_latest(t: Tables) -> DataFrame:
    return store.latest_artifacts(t.artifacts)


@query("SELECT run_id, status FROM runs WHERE status IN ('running', 'paused')", "runs")
def resumable_runs(t: Tables) -> DataFrame:
    return store.resumable(t.runs).select("run_id", "status")


@query("SELECT run_id, job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, run_id DESC) AS INT) AS place FROM runs WHERE status = 'done' AND job_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", "runs")
def history_view(t: Tables) -> DataFrame:
    folders = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("job_id"))
    return store.history(t.runs, folders).select("run_id", "job_id", "place")


@query(
    """, g AS (SELECT run_id FROM runs WHERE job_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0))
    SELECT 'runs' AS kind, count(*) FILTER (job_id % 3 <> 0 AND job_id IN (SELECT c_custkey FROM customer)) AS restored, count(*) FILTER (job_id % 3 = 0 OR job_id NOT IN (SELECT c_custkey FROM customer)) AS skipped FROM runs
    UNION ALL SELECT 'artifacts', count(*) FILTER (l_orderkey IN (SELECT run_id FROM g)), count(*) FILTER (l_orderkey NOT IN (SELECT run_id FROM g)) FROM lineitem""",
    "runs",
)
def restore_filter(t: Tables) -> DataFrame:
    jobs = t.customer.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("job_id"))
    return store.restorable(jobs, t.runs, t.artifacts)


@query("SELECT l_returnflag AS kind, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT run_id FROM runs WHERE job_id % 7 = 0) GROUP BY 1", "runs")
def cascade_survivors(t: Tables) -> DataFrame:
    return store.survivors(t.runs, t.artifacts, t.customer.filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("job_id")))


@query("SELECT run_id, round(progress, 9) AS progress FROM progress", "progress")
def run_progress(t: Tables) -> DataFrame:
    return t.run_pages.select("run_id", F.round("progress", 9).alias("progress"))


@query("SELECT job_id, round(sum(progress * greatest(1, page_count)) / sum(greatest(1, page_count)), 9) AS progress FROM progress GROUP BY 1", "progress")
def batch_progress(t: Tables) -> DataFrame:
    return telemetry.batch_progress(t.run_pages).select("job_id", F.round("progress", 9).alias("progress"))


@query("SELECT CAST(t AS DATE) AS day, model, count(*) AS requests, greatest(0, 500 - count(*)) AS \"left\" FROM log GROUP BY 1, 2", "log")
def daily_quota(t: Tables) -> DataFrame:
    return telemetry.daily_quota(t.log)


@query("SELECT event, round(sum(ms), 4) AS total_ms, count(*) AS n FROM log GROUP BY 1", "log")
def stage_totals(t: Tables) -> DataFrame:
    return telemetry.stage_totals(t.log).withColumn("total_ms", F.round("total_ms", 4))


@query("SELECT run_id, round(sum(ms), 4) AS total_ms, count(*) AS n, round((epoch_us(max(t)) - epoch_us(min(t))) / 60000000.0::DOUBLE, 6) AS minutes FROM log GROUP BY 1", "log")
def run_timings(t: Tables) -> DataFrame:
    return telemetry.run_timings(t.log).withColumn("total_ms", F.round("total_ms", 4)).withColumn("minutes", F.round("minutes", 6))


@query("SELECT run_id, min(seq) AS first_seq, count(*) AS n, count(*) FILTER (level <> 'info') AS problems FROM log GROUP BY 1", "log")
def log_groups(t: Tables) -> DataFrame:
    return telemetry.log_groups(t.log)


@query(
    """SELECT seq, count(*) OVER (PARTITION BY run_id ORDER BY t RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS recent, round((epoch_us(t) - lag(epoch_us(t)) OVER (PARTITION BY run_id ORDER BY t, seq)) / 1000000.0::DOUBLE, 6) AS gap_s FROM log""",
    "log",
)
def rate_window(t: Tables) -> DataFrame:
    return telemetry.rate_window(t.log, 3600, "run_id").select("seq", "recent", F.round("gap_s", 6).alias("gap_s"))


@query(
    """, i AS (SELECT *, sum(CASE WHEN event <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY t, seq) AS isl FROM log), s AS (SELECT run_id, seq, event, sum(CASE WHEN event = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, isl ORDER BY t, seq) AS k FROM i)
    SELECT run_id, seq, CAST(k AS BIGINT) AS streak, k >= 3 AS demoted FROM s WHERE event = 'error'""",
    "log",
)
def failure_streaks(t: Tables) -> DataFrame:
    return telemetry.failure_streaks(t.log)


@query("SELECT run_id, seq, CAST(k AS INT) AS age FROM (SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS k FROM log) WHERE k <= 50", "log")
def ring_buffer(t: Tables) -> DataFrame:
    return telemetry.newest(t.log, 50, "run_id").select("run_id", "seq", "age")


@query(
    """WITH f AS (SELECT 'r' || CAST(o_custkey % 10 AS VARCHAR) AS folder, CASE WHEN o_orderkey % 2 = 0 THEN 'auto-' ELSE 'manual-' END || strftime(o_orderdate, '%Y%m%d') || '-' || CAST(o_orderkey AS VARCHAR) AS name FROM orders)
    SELECT folder, name FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY name DESC) AS k FROM f WHERE starts_with(name, 'auto-')) WHERE k > 5""",
)
def retention(t: Tables) -> DataFrame:
    prefix = F.when(F.col("o_orderkey") % 2 == 0, "auto-").otherwise("manual-")
    name = F.concat(prefix, F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"), F.col("o_orderkey").cast("string"))
    return store.backups_to_drop(t.orders.select(F.concat(F.lit("r"), (F.col("o_custkey") % 10).cast("string")).alias("folder"), name.alias("name")))


@query(
    """, u AS (SELECT run_id, seq // 3 AS message, seq, CAST(floor(ms) AS BIGINT) AS tokens, model, t FROM log WHERE k IS NOT NULL), o AS (SELECT run_id, message, arg_max(tokens, seq) AS tokens, arg_max(model, seq) AS model, min(t) AS t0, max(t) AS t1 FROM u GROUP BY 1, 2),
    m AS (SELECT run_id, model, row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, model DESC) AS k FROM o GROUP BY 1, 2)
    SELECT o.run_id, count(*) AS messages, CAST(sum(tokens) AS BIGINT) AS tokens, epoch_us(min(t0)) AS first_us, epoch_us(max(t1)) AS last_us, any_value(m.model) AS model FROM o JOIN m ON o.run_id = m.run_id AND m.k = 1 GROUP BY 1""",
    "log",
)
def token_rollup(t: Tables) -> DataFrame:
    usage = t.log.filter("k is not null").select("run_id", F.floor(F.col("seq") / 3).alias("message"), "seq", F.floor("ms").cast("long").alias("tokens"), "model", "t")
    out = telemetry.token_rollup(usage)
    return out.select("run_id", "messages", "tokens", F.unix_micros("first_t").alias("first_us"), F.unix_micros("last_t").alias("last_us"), "model")


@query(
    r""", p AS (SELECT *, substr(trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')), 1, 120) AS plain FROM exam_rows), d AS (SELECT run_id, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT run_id, plain, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY 1)
    SELECT run_id, count(*) AS n_rows, count(*) FILTER (correct_index <> '') AS answered, count(*) FILTER (correct_index = '' OR needs_review <> '') AS flagged, count(*) FILTER (len(options) < 2) AS few_options, count(*) FILTER (len(options) >= 2 AND len(options) < mode) AS below_mode,
    count(*) FILTER (length(question) < 20) AS short_questions, count(*) FILTER (regexp_matches(question, '^\s*(?:Q\s*)?[0-9]{1,3}\s*[.)]')) AS number_leaks, count(*) FILTER (image_url <> '') AS with_image, CAST(max(mode) AS INT) AS mode, any_value(duplicates) AS duplicates FROM p JOIN modes USING (run_id) JOIN d USING (run_id) GROUP BY 1""",
    "modes",
)
def grade_report(t: Tables) -> DataFrame:
    return grading.grade_report(t.v1)


@query(
    """, tr AS (SELECT 'src' || CAST(doc_id % 20 AS VARCHAR) AS run_id, CAST(doc_id AS VARCHAR) AS id, max(quality) AS expected FROM labels GROUP BY 1, 2), j AS (SELECT tr.*, e.id IS NOT NULL AS found, CASE WHEN regexp_full_match(e.correct_index, '[0-9]+') THEN CAST(e.correct_index AS INT) END AS given FROM tr LEFT JOIN exam_rows e ON tr.run_id = e.run_id AND tr.id = e.id)
    SELECT run_id, count(*) FILTER (given = expected) AS correct, count(*) FILTER (given <> expected) AS wrong, count(*) FILTER (found AND given IS NULL) AS missed, count(*) FILTER (NOT found) AS not_found FROM j GROUP BY 1""",
    "exam_rows",
)
def truth_score(t: Tables) -> DataFrame:
    truth = t.labels.groupBy(F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("run_id"), F.col("doc_id").cast("string").alias("id")).agg(F.max("quality").alias("expected"))
    return grading.truth_score(t.v1, truth)


def _alike(t: Tables) -> DataFrame:
    texts = t.documents.select(F.col("doc_id").alias("id"), "text")
    return grading.similarity_candidates(texts, texts, ascending=True)


_FOLDED = squeezed("regexp_replace(regexp_replace(regexp_replace(text, '[‘’ʼ]', '''', 'g'), '[“”]', '\"', 'g'), '[‐-―]', '-', 'g')")


@query(
    f"""WITH k AS (SELECT doc_id, list_distinct(list_filter(string_split({_FOLDED}, ' '), lambda x: length(x) > 2)) AS tk FROM documents), f AS (SELECT doc_id, len(tk) AS n, unnest(tk) AS tok FROM k)
    SELECT r.doc_id AS ref_id, v.doc_id AS var_id, round(count(*) / greatest(r.n, v.n)::DOUBLE, 9) AS score FROM f r JOIN f v ON r.tok = v.tok WHERE r.doc_id < v.doc_id GROUP BY r.doc_id, v.doc_id, r.n, v.n HAVING count(*) / greatest(r.n, v.n)::DOUBLE >= 0.5"""
)
def similarity_candidates(t: Tables) -> DataFrame:
    return _alike(t).withColumn("score", F.round("score", 9))


@query(
    f"""WITH RECURSIVE k AS (SELECT doc_id, source, list_distinct(list_filter(string_split({_FOLDED}, ' '), lambda x: length(x) > 2)) AS tk FROM documents), f AS (SELECT doc_id, source, len(tk) AS n, unnest(tk) AS tok FROM k),
    c AS (SELECT r.source AS exam, r.doc_id AS ref_id, v.doc_id AS var_id, count(*) / greatest(r.n, v.n)::DOUBLE AS score FROM f r JOIN f v ON r.tok = v.tok WHERE r.doc_id < v.doc_id GROUP BY r.source, r.doc_id, v.doc_id, r.n, v.n HAVING count(*) / greatest(r.n, v.n)::DOUBLE >= 0.5),
    s AS (SELECT exam, ref_id, list(struct_pack(v := var_id, s := score) ORDER BY score DESC, var_id) AS cands, row_number() OVER (PARTITION BY exam ORDER BY ref_id) AS i FROM c GROUP BY exam, ref_id),
    t AS (SELECT DISTINCT exam, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS ref_id, CAST(NULL AS STRUCT(v BIGINT, s DOUBLE)) AS got, CAST([] AS BIGINT[]) AS used FROM s
        UNION ALL SELECT exam, i, ref_id, got, CASE WHEN got IS NULL THEN used ELSE list_append(used, got.v) END FROM (SELECT s.exam, s.i, s.ref_id, list_filter(cands, lambda x: NOT list_contains(used, x.v))[1] AS got, used FROM t JOIN s ON s.exam = t.exam AND s.i = t.i + 1))
    SELECT exam, ref_id, got.v AS var_id, round(got.s, 9) AS score FROM t WHERE got IS NOT NULL"""
)
def greedy_alignment(t: Tables) -> DataFrame:
    exams = t.documents.select(F.col("doc_id").alias("ref_id"), F.col("source").alias("exam"))
    return grading.greedy_alignment(_alike(t).join(exams, "ref_id"), "exam").withColumn("score", F.round("score", 9))


_PLAIN = trim(r"regexp_replace(text, '[\s\x{{00A0}}\x{{FEFF}}]+', ' ', 'g')".replace("{{", "{").replace("}}", "}"))


@query(
    rf"""SELECT doc_id AS id, CAST(length({_PLAIN}) AS INT) AS chars, CASE WHEN length({_PLAIN}) < 200 THEN 'scan' WHEN length({_PLAIN}) < 900 THEN 'sparse' ELSE 'digital' END AS capture,
    CAST(len(regexp_extract_all(text, '(?i)(?:^|\s)(?:q\s*)?[0-9]{{1,3}}\s*[.)\-:]\s')) AS INT) AS question_labels, CAST(len(regexp_extract_all(text, '(?:^|\s)\(?[a-eA-E]\s*[.)-]\s')) AS INT) AS option_labels,
    CAST(len(regexp_extract_all(text, '(?i)\b(?:answer|ans|correct)\b\s*[:.-]?\s*\(?[a-e]\)?\b')) AS INT) AS printed_answers, regexp_matches(text, '[\x{{0600}}-\x{{06FF}}]') AS arabic FROM documents"""
)
def corpus_survey(t: Tables) -> DataFrame:
    return grading.survey(t.documents.select(F.col("doc_id").alias("id"), "text"))


@query("WITH m AS (SELECT doc_id AS id, text, strpos(lower(text), 'license') AS i FROM documents) SELECT id, CAST(i AS INT) AS \"at\", substr(text, greatest(1, i - 120), least(i - 1, 120) + 220) AS snippet FROM m WHERE i > 0")
def corpus_grep(t: Tables) -> DataFrame:
    return grading.grep(t.documents.select(F.col("doc_id").alias("id"), "text"), "license")


@query(
    """, r AS (SELECT e.*, CASE WHEN regexp_full_match(correct_index, '[0-9]+') THEN CAST(correct_index AS INT) END AS i FROM exam_rows e)
    SELECT run_id, id, 'invalid_answer' AS problem FROM r WHERE correct_index <> '' AND (i IS NULL OR i >= len(options)) UNION ALL SELECT run_id, id, 'few_options' FROM r WHERE len(options) < 2
    UNION ALL SELECT run_id, id, 'unknown_figure' FROM r WHERE image_url <> '' AND NOT EXISTS (SELECT 1 FROM exam_rows x WHERE x.run_id = r.run_id AND x.image_url = r.image_url AND x.doc_id % 20 = 0)""",
    "exam_rows",
)
def manifest_validation(t: Tables) -> DataFrame:
    rows = t.v1
    return grading.manifest_problems(rows, rows.filter("doc_id % 20 = 0 and image_url <> ''"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 THEN 6 WHEN k BETWEEN 3 AND 80 THEN k ELSE 6 END AS INT) AS chunk FROM (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def json_field_narrowing(t: Tables) -> DataFrame:
    broken = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return t.events.select("event_id", telemetry.narrowed(broken, "k", 3, 80, 6).alias("chunk"))


def _chunks(t: Tables) -> tuple[DataFrame, DataFrame]:
    planned = t.v2.withColumn("chunk", F.floor(F.col("pos") / 10).cast("int")).select("run_id", "chunk", "pos", "id", "doc_id")
    worker = planned.filter("doc_id % 29 <> 0").withColumn("pos", F.when(F.col("doc_id") % 31 == 0, F.col("pos") + 2).otherwise(F.col("pos")))
    return planned, worker


@query(
    """, p AS (SELECT *, CAST(pos // 10 AS INT) AS chunk FROM planned), a AS (SELECT run_id, chunk, id, row_number() OVER (PARTITION BY run_id, chunk ORDER BY pos, id) AS n FROM p),
    b AS (SELECT run_id, chunk, id, row_number() OVER (PARTITION BY run_id, chunk ORDER BY pos + CASE WHEN doc_id % 31 = 0 THEN 2.5 ELSE 0 END) AS n FROM p WHERE doc_id % 29 <> 0),
    j AS (SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.chunk, b.chunk) AS chunk, count(a.id) AS w, count(b.id) AS s, count(*) FILTER (a.id <> b.id) AS o FROM a FULL JOIN b ON a.run_id = b.run_id AND a.chunk = b.chunk AND a.n = b.n GROUP BY 1, 2)
    SELECT run_id, chunk, CASE WHEN w <> s THEN 'row_count' ELSE 'id_order' END AS violation FROM j WHERE w <> s OR o > 0""",
    "planned",
)
def chunk_violations(t: Tables) -> DataFrame:
    planned, worker = _chunks(t)
    worker = worker.withColumn("pos", F.col("pos") + F.when(F.col("doc_id") % 31 == 0, 0.5).otherwise(0.0))
    return assembly.chunk_violations(planned, worker)


@query(
    """, q AS (SELECT run_id, CAST(pos // 10 AS INT) AS chunk, id, len(options) AS n FROM exam_rows WHERE doc_id % 3 = 0), r AS (SELECT run_id, CAST(pos // 10 AS INT) AS chunk, id, ai.ai AS idx, confidence FROM exam_rows JOIN ai USING (doc_id))
    SELECT coalesce(q.run_id, r.run_id) AS run_id, coalesce(q.chunk, r.chunk) AS chunk, bool_and(coalesce(q.id IS NOT NULL AND r.id IS NOT NULL AND (idx IS NULL OR idx < n), false)) AS accepted FROM q FULL JOIN r ON q.run_id = r.run_id AND q.chunk = r.chunk AND q.id = r.id GROUP BY 1, 2""",
    "exam_rows",
    "ai",
)
def solver_chunks(t: Tables) -> DataFrame:
    rows = t.v1.withColumn("chunk", F.floor(F.col("pos") / 10).cast("int"))
    requested = rows.filter("doc_id % 3 = 0").select("run_id", "chunk", "id", F.size("options").alias("n_options"))
    response = rows.join(t.ai, "doc_id").select("run_id", "chunk", "id", F.col("ai").alias("idx"), "confidence")
    return assembly.solver_chunks(requested, response)


@query(
    """, f AS (SELECT DISTINCT run_id, page, ordinal FROM obs WHERE is_core AND pos % 5 = 0), a AS (SELECT *, 'images/asset' || lpad(CAST(row_number() OVER (PARTITION BY run_id ORDER BY page, ordinal) AS VARCHAR), 2, '0') || '.jpg' AS path FROM f)
    SELECT o.run_id, CAST(o.pos AS VARCHAR) AS id, path FROM obs o JOIN a USING (run_id, page, ordinal) WHERE is_core AND pos % 5 = 0""",
    "obs",
)
def figure_links(t: Tables) -> DataFrame:
    seen = t.seen.filter("is_core")
    figures = seen.filter("pos % 5 = 0").select("run_id", "page", "ordinal", F.array("ref", F.lit("unknown")).alias("refs"))
    _, links = assembly.figure_links(figures, seen.select("run_id", "ref", F.col("pos").cast("string").alias("id")))
    return links


@query(
    """, l AS (SELECT run_id, page, correct_index AS letter, row_number() OVER (PARTITION BY run_id, page ORDER BY pos) AS n, count(*) OVER (PARTITION BY run_id, page) AS c FROM exam_rows e JOIN (SELECT run_id, id, page FROM planned) p USING (run_id, id) WHERE correct_index <> ''),
    q AS (SELECT run_id, page, id, row_number() OVER (PARTITION BY run_id, page ORDER BY pos) AS n, count(*) OVER (PARTITION BY run_id, page) AS c FROM planned WHERE doc_id % 7 <> 0) SELECT run_id, page, id, letter FROM l JOIN q USING (run_id, page, n, c)""",
    "exam_rows",
    "planned",
)
def ordinal_pairs(t: Tables) -> DataFrame:
    planned = t.v2
    letters = planned.join(t.v1.select("run_id", "id", "correct_index"), ["run_id", "id"]).filter("correct_index <> ''").select("run_id", "page", "pos", F.col("correct_index").alias("letter"))
    return assembly.ordinal_pairs(letters, planned.filter("doc_id % 7 <> 0"))


@query(
    r"""SELECT run_id, bool_or(regexp_matches(question || ' ' || array_to_string(options, ' '), '(?i)\b(question\s+[0-9]+|q[0-9]+|q\s+[0-9]+|previous\s+question|above\s+question)\b')) AS refers,
    bool_or(regexp_matches(question || ' ' || array_to_string(options, ' '), '(?i)\bmatch(?:es|ed|ing)?\b|\bpair(?:s|ed|ing)?\b')) AS matches FROM exam_rows GROUP BY 1""",
    "exam_rows",
)
def question_gates(t: Tables) -> DataFrame:
    return assembly.gates(t.v1)


@query(
    """SELECT run_id, CASE count(DISTINCT policy) FILTER (policy NOT IN ('none', 'no_answer_key')) WHEN 0 THEN 'no_answer_key' WHEN 1 THEN max(policy) FILTER (policy NOT IN ('none', 'no_answer_key')) ELSE 'mixed' END AS policy, bool_or(doc_id % 50 = 0) AS has_key FROM (SELECT run_id, doc_id, CASE WHEN doc_id % 97 = 0 THEN 'inline_marks' ELSE policy END AS policy FROM planned) GROUP BY 1""",
    "planned",
)
def united_policies(t: Tables) -> DataFrame:
    evidence = F.when(F.col("doc_id") % 97 == 0, "inline_marks").otherwise(F.col("policy"))
    return assembly.united_policy(t.v2.select("run_id", evidence.alias("evidence"), (F.col("doc_id") % 50 == 0).alias("has_key")))


@query(
    """SELECT e.id, CAST(coalesce(min(x.pos) FILTER (x.pos > e.pos), min(x.pos) FILTER (x.pos < e.pos)) AS INT) AS next_open FROM exam_rows e LEFT JOIN category x ON x.run_id = e.run_id AND x.flagged GROUP BY e.id""",
    "exam_rows",
    "category",
)
def next_unresolved(t: Tables) -> DataFrame:
    return assembly.next_unresolved(t.v1, review.is_flagged()).select("id", "next_open")


@query(
    """, g AS (SELECT DISTINCT run_id, page FROM planned), n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY page) - 1 AS k, greatest(1, count(*) OVER (PARTITION BY run_id) // least(8, count(*) OVER (PARTITION BY run_id))) AS step FROM g) SELECT run_id, page FROM n WHERE k % step = 0 AND k // step < 8""",
    "planned",
)
def sampled_pages(t: Tables) -> DataFrame:
    return assembly.sampled_pages(t.v2.select("run_id", "page").distinct())


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE round(value, 3) END AS delay FROM events")
def retry_delays(t: Tables) -> DataFrame:
    value = F.round("value", 3).cast("decimal(18,3)").cast("string")
    said = F.when(F.col("event_id") % 4 == 0, F.concat(value, F.lit("s"))).when(F.col("event_id") % 4 == 3, F.concat(F.lit("in "), value)).otherwise(F.concat(F.lit(" "), value))
    return t.events.select("event_id", assembly.retry_delay(said).alias("delay"))


@query(
    """, o AS (SELECT id, doc_id, options AS b FROM exam_rows), r AS (SELECT *, list_reverse(list_sort(list_distinct(b))) AS a, CAST(doc_id % 4 AS INT) AS i FROM o)
    SELECT id, CASE WHEN i < len(b) THEN CAST(list_position(list_slice(a, 1, 3), b[i + 1]) - 1 AS BIGINT) END AS idx FROM r""",
    "exam_rows",
)
def remapped_answers(t: Tables) -> DataFrame:
    after = F.slice(F.sort_array(F.array_distinct("options"), asc=False), 1, 3)
    return t.v1.select("id", assembly.remapped_index((F.col("doc_id") % 4).cast("int"), F.col("options"), after).alias("idx"))

# The queries of these modules register themselves, with what stands above.
from examloom.plans import blueprint_queries, edit_queries, narrowing_queries, outcome_queries, planning_queries, source_queries, store_queries  # noqa: E402,F401
