"""The derived relations once more, as DuckDB common table expressions: independent of the Spark code on purpose."""

from __future__ import annotations

TRIM = r"regexp_replace({0}, '^[\s\x{{00A0}}\x{{FEFF}}]+|[\s\x{{00A0}}\x{{FEFF}}]+$', '', 'g')"
SQUEEZED = r"lower(" + TRIM.replace("{0}", r"regexp_replace({0}, '[\s\x{{00A0}}\x{{FEFF}}]+', ' ', 'g')") + ")"


def trim(x: str) -> str:
    return TRIM.format(x)


def squeezed(x: str) -> str:
    return SQUEEZED.format(x)


PARTS = {
    "exam_rows": (
        (),
        """SELECT source AS run_id, pos, doc_id, CAST(doc_id AS VARCHAR) AS id,
        CASE doc_id % 4 WHEN 0 THEN CAST(pos AS VARCHAR) || '. ' WHEN 1 THEN 'Q' || CAST(pos AS VARCHAR) || ') ' ELSE '' END || array_to_string(list_concat(list_slice(w, 1, 12), list_slice(w, 13 + doc_id % 6, len(w))), ' ') AS question,
        list_slice(w, 13, 12 + doc_id % 6) AS options,
        CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 = 0 THEN 'x' ELSE CAST(doc_id % 5 AS VARCHAR) END AS correct_index,
        CASE doc_id % 13 WHEN 0 THEN 'no_answer_key' WHEN 1 THEN 'conflicting_marks' WHEN 2 THEN 'options_cut_at_page_break' WHEN 3 THEN 'key_unclear' WHEN 4 THEN 'not_mcq' ELSE '' END AS needs_review,
        CASE WHEN doc_id % 3 = 0 THEN '2024' ELSE '' END AS year,
        CASE WHEN doc_id % 10 = 0 THEN 'images/asset' || lpad(CAST(pos AS VARCHAR), 2, '0') || '.png' ELSE '' END AS image_url
        FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, string_split(text, ' ') AS w FROM documents)""",
    ),
    "planned": (
        ("exam_rows",),
        """SELECT *, max(page) OVER (PARTITION BY run_id) AS page_count FROM (SELECT run_id, pos, doc_id, id,
        CASE CAST(regexp_extract(run_id, '([0-9]+)$', 1) AS INT) % 5 WHEN 0 THEN 'no_answer_key' WHEN 1 THEN 'separate_key' WHEN 2 THEN 'inline_marks' WHEN 3 THEN 'mixed' ELSE 'uncertain' END AS policy,
        CASE WHEN needs_review IN ('conflicting_marks', 'key_unclear') THEN needs_review ELSE '' END AS reason,
        CAST(pos // 5 + 1 AS INT) AS page, image_url FROM exam_rows WHERE doc_id % 19 <> 0)""",
    ),
    "picks": ((), "SELECT doc_id, max(quality + 2 * toxic) AS pick FROM labels GROUP BY doc_id"),
    "edits": ((), "SELECT item_id AS doc_id, text AS new_question, CASE WHEN item_id % 2 = 0 THEN 'T' || CAST(item_id % 3 AS VARCHAR) END AS new_topic FROM benchmark"),
    "deleted": ((), "SELECT DISTINCT doc_id FROM labels WHERE toxic = 1 AND doc_id % 2 = 0"),
    "added": ((), "SELECT 'src' || CAST(conv_id % 20 AS VARCHAR) AS run_id, 'added-' || CAST(conv_id AS VARCHAR) AS id FROM conversations WHERE turn = 0"),
    "ai": ((), "SELECT doc_id, max(quality + toxic) AS ai, CASE doc_id % 4 WHEN 0 THEN 'certain' WHEN 1 THEN 'likely' ELSE 'unsure' END AS confidence FROM labels WHERE doc_id % 3 = 0 GROUP BY doc_id"),
    "topics": ((), "SELECT r_name AS topic, n_name AS subtopic FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "topic_picks": (
        (),
        """SELECT s_suppkey AS row_id, CASE WHEN s_suppkey % 10 IN (1, 2) THEN '' WHEN s_suppkey % 10 = 3 THEN 'NOWHERE' ELSE r_name END AS topic, CASE WHEN s_suppkey % 10 = 2 THEN '' ELSE n_name END AS subtopic
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON r_regionkey = CASE WHEN s_suppkey % 10 = 0 THEN (n_regionkey + 1) % 5 ELSE n_regionkey END""",
    ),
    "validated": (
        ("topics", "topic_picks"),
        """SELECT row_id, topic, subtopic, CASE WHEN topic = '' AND subtopic <> '' THEN 'subtopic_without_topic' WHEN topic = '' THEN 'unsure'
        WHEN topic NOT IN (SELECT topic FROM topics) THEN 'topic_not_listed' WHEN subtopic <> '' AND NOT EXISTS (SELECT 1 FROM topics t WHERE t.topic = p.topic AND t.subtopic = p.subtopic) THEN 'subtopic_not_listed' ELSE 'ok' END AS status FROM topic_picks p""",
    ),
    "matched": (("validated",), "SELECT row_id AS doc_id, topic, subtopic FROM validated WHERE status IN ('ok', 'unsure')"),
    "cont": ((), "SELECT conv_id AS run_id, turn AS pos, turn AS page, role <> 'user' AS continuation, list_slice(string_split(text, ' '), 1, turn % 4 + 1) AS options FROM conversations"),
    "chained": (
        (),
        """SELECT conv_id AS run_id, turn AS pos, turn // 2 AS page, (turn + conv_id) % 4 <> 0 AS continuation, list_slice(string_split(text, ' '), 1, turn % 4 + 1) AS options, CASE WHEN turn % 3 = 0 THEN '' ELSE CAST(turn % (turn % 4 + 1) AS VARCHAR) END AS correct_index,
        CASE turn % 5 WHEN 0 THEN 'no_visible_answer' WHEN 1 THEN '' WHEN 2 THEN 'key_unclear' WHEN 3 THEN 'options_cut_at_page_break' ELSE 'incomplete_options' END AS needs_review FROM conversations""",
    ),
    "log": (
        (),
        """SELECT seq, t, event, run_id, ms, k, CASE event WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS level, CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END AS model
        FROM (SELECT event_id AS seq, ts AS t, event_type AS event, user_id AS run_id, value AS ms, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
    ),
    "seen": (
        ("exam_rows",),
        """SELECT run_id, pos, CAST(pos // 10 AS INT) AS win, CAST(pos % 10 AS INT) AS ordinal, CAST(pos // 3 + 1 AS INT) AS page, CASE WHEN pos % 7 = 0 THEN '' ELSE CAST(pos % 7 AS VARCHAR) END AS label,
        array_to_string(list_slice(string_split(question, ' '), 1, 6), ' ') AS anchor, true AS is_core FROM exam_rows
        UNION ALL SELECT run_id, pos, CAST(pos // 10 - 1 AS INT), 10, CAST(pos // 3 + 1 AS INT), CASE WHEN pos % 7 = 0 THEN '' ELSE CAST(pos % 7 AS VARCHAR) END,
        array_to_string(list_slice(string_split(question, ' '), 1, 6), ' '), false FROM exam_rows WHERE pos % 10 = 0 AND pos // 10 > 0""",
    ),
    "obs": (("seen",), "SELECT *, 'w' || CAST(win AS VARCHAR) || 'q' || CAST(ordinal AS VARCHAR) AS ref FROM seen"),
    "art": (
        (),
        """SELECT l_orderkey AS run_id, l_returnflag AS kind, l_shipdate AS created_at, concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS path,
        row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS rn,
        count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS copies FROM lineitem""",
    ),
    "runs": ((), "SELECT o_orderkey AS run_id, o_custkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'paused' END AS status, o_orderdate AS created_at FROM orders"),
    "run_pages": (
        ("runs",),
        """SELECT runs.*, coalesce(page_count, 0) AS page_count, coalesce(pages_rendered, 0) AS pages_rendered FROM runs LEFT JOIN
        (SELECT l_orderkey, count(*) AS page_count, count(*) FILTER (l_linestatus = 'F') AS pages_rendered FROM lineitem GROUP BY 1) ON run_id = l_orderkey""",
    ),
    "progress": (
        ("run_pages",),
        """SELECT *, CASE WHEN status = 'done' THEN 1.0::DOUBLE WHEN status = 'running' THEN 0.2::DOUBLE * (CASE WHEN page_count = 0 THEN 0 ELSE least(1, pages_rendered::DOUBLE / page_count) END)
        ELSE 0.45::DOUBLE + 0.4::DOUBLE * (CASE WHEN page_count = 0 THEN 0 ELSE least(1, pages_rendered::DOUBLE / page_count) END) END AS progress FROM run_pages""",
    ),
    "geo": (
        (),
        """SELECT run_id, page, row_id, py0, px0, py0 + 20 AS py1, px0 + 450 AS px1, py0 + 20 AS oy0, px0 AS ox0, py0 + 20 + q AS oy1, px0 + 450 AS ox1 FROM (
        SELECT CAST(l_orderkey // 64 AS BIGINT) AS run_id, CAST(l_orderkey % 4 + 1 AS INT) AS page, concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id,
        CAST((l_partkey * 7) % 900 AS DOUBLE) AS py0, CAST((l_suppkey * 13) % 2 * 500 AS DOUBLE) AS px0, l_quantity AS q FROM lineitem)""",
    ),
    "below": (
        ("geo",),
        """SELECT g.run_id, g.row_id, min(o.py0) AS next_top FROM geo g JOIN geo o ON g.run_id = o.run_id AND g.page = o.page AND o.row_id <> g.row_id AND o.py0 > g.oy0 AND o.px1 > g.ox0 AND o.px0 < g.ox1 GROUP BY 1, 2""",
    ),
    "next_tops": (("below",), "SELECT geo.*, next_top FROM geo LEFT JOIN below USING (run_id, row_id)"),
    "files": ((), "SELECT p_partkey AS seq, CASE WHEN p_partkey % 2 = 0 THEN upper(n) ELSE n END AS file_name FROM (SELECT p_partkey, p_name || ' (v' || CAST(p_size % 3 AS VARCHAR) || ').PDF' AS n FROM part)"),
    "category": (
        ("exam_rows",),
        """SELECT *, CASE WHEN needs_review LIKE '%not_mcq%' THEN 'not-mcq' WHEN needs_review LIKE '%conflict%' OR needs_review LIKE '%multiple@_mark%' ESCAPE '@' THEN 'conflicting-marks'
        WHEN needs_review LIKE '%label%' OR needs_review LIKE '%option%' OR needs_review LIKE '%length%' THEN 'length-mismatch'
        WHEN needs_review LIKE '%unclear%' OR needs_review LIKE '%illegible%' OR needs_review LIKE '%unreadable%' OR needs_review LIKE '%empty%' OR needs_review LIKE '%low@_confidence%' ESCAPE '@' OR correct_index <> '' THEN 'low-confidence'
        ELSE 'blank-answer' END AS category, correct_index = '' OR needs_review <> '' AS flagged FROM exam_rows""",
    ),
    "resolved": (
        ("exam_rows", "picks"),
        """SELECT e.* REPLACE (CASE WHEN coalesce(pick < len(options), false) THEN CAST(pick AS VARCHAR) ELSE correct_index END AS correct_index, CASE WHEN coalesce(pick < len(options), false) THEN '' ELSE needs_review END AS needs_review),
        coalesce(pick < len(options), false) AS resolved FROM exam_rows e LEFT JOIN picks USING (doc_id)""",
    ),
    "based": (
        ("exam_rows", "added", "deleted", "edits"),
        """SELECT r.* REPLACE (coalesce(new_question, question) AS question) FROM (SELECT run_id, pos, doc_id, id, question, options, correct_index, needs_review, year, image_url FROM exam_rows
        UNION ALL SELECT run_id, 1073741824, NULL, id, '', CAST([] AS VARCHAR[]), '', '', '', '' FROM added) r LEFT JOIN edits USING (doc_id) WHERE r.doc_id IS NULL OR r.doc_id NOT IN (SELECT doc_id FROM deleted)""",
    ),
    "reviewed": (
        ("based", "picks"),
        """SELECT b.* REPLACE (CASE WHEN coalesce(pick < len(options), false) THEN CAST(pick AS VARCHAR) ELSE correct_index END AS correct_index, CASE WHEN coalesce(pick < len(options), false) THEN '' ELSE needs_review END AS needs_review)
        FROM based b LEFT JOIN picks USING (doc_id)""",
    ),
    "forced": (
        ("exam_rows", "planned"),
        """SELECT p.run_id, p.id, p.pos, p.page, p.policy, p.reason, e.question, e.options, e.image_url, a,
        CASE WHEN policy IN ('no_answer_key', 'uncertain') THEN policy WHEN reason <> '' THEN reason WHEN a = '' THEN 'no_visible_answer' WHEN NOT regexp_full_match(a, '[0-9]+') THEN 'key_unclear'
        WHEN TRY_CAST(a AS INT) >= len(options) THEN 'index_out_of_range' ELSE '' END AS why FROM planned p JOIN (SELECT *, trim(correct_index) AS a FROM exam_rows) e USING (run_id, id)""",
    ),
    "modes": (
        ("exam_rows",),
        """SELECT run_id, CASE WHEN votes >= 4 AND h * 2 >= votes THEN n END AS mode FROM (SELECT *, sum(CASE WHEN n >= 2 THEN h END) OVER (PARTITION BY run_id) AS votes, row_number() OVER (PARTITION BY run_id ORDER BY (n >= 2) DESC, h DESC, n DESC) AS rn
        FROM (SELECT run_id, len(options) AS n, count(*) AS h FROM exam_rows GROUP BY 1, 2)) WHERE rn = 1""",
    ),
}
BARE_QUESTION = r"regexp_replace(question, '^\s*(?:q(?:uestion)?\s*)?[0-9]{1,3}\s*[.):\-–—]\s+', '', 'i')"


def sql(select: str, *needs: str) -> str:
    """``select`` behind the relations it needs; one that starts with RECURSIVE may refer to itself."""
    order: list[str] = []
    recursive = "RECURSIVE " if select.startswith("RECURSIVE") else ""
    select = select.removeprefix("RECURSIVE")

    def visit(name: str) -> None:
        if name not in order:
            for n in PARTS[name][0]:
                visit(n)
            order.append(name)

    for n in needs:
        visit(n)
    return (f"WITH {recursive}" + ", ".join(f"{n} AS ({PARTS[n][1]})" for n in order) + " " if order else "") + select
