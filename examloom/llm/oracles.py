"""DuckDB SQL for the queries of this subpackage that SQL can express; written without regard to scale."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS w FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS s FROM b)),
d AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS k FROM w) WHERE k > 1),
i AS (SELECT doc_id, s, sum(CASE WHEN s <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM d)),
r AS (SELECT doc_id, min(s) AS lo, max(s) + 100 AS hi FROM i GROUP BY doc_id, run),
k AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS done FROM r),
c AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * done + 1, 2 * (lo - done)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS kept FROM k JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM b LEFT JOIN c USING (doc_id)
"""

OP4 = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, e.y FROM r JOIN both_ways e ON e.x = r.reached)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(reached) AS component_id FROM r GROUP BY node) m ON m.node = d.doc_id
"""


def op8(rules: list[tuple[str, str]], damping: float, decimals: int, steps: int = 200) -> str:
    """``rules``: (verdict, text). After ``steps`` steps, less than 1e-14 of the trust is on its way."""
    name, verdict = "NULL", "NULL"
    for v, text in sorted(rules, key=lambda r: (len(r[1]), len(r[1].partition("/")[0]), r[1])):
        host, slash, path = text.partition("/")
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}')"
        name, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {name} END", f"CASE WHEN {fits} THEN '{v}' ELSE {verdict} END"
    d = f"{damping}::DOUBLE"
    host_of = f"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}')"
    parts = [
        f"u AS (SELECT page_id, html, {host_of} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)",
        f"j AS (SELECT page_id, host, path, {name} AS rule, {verdict} AS ruled FROM u)",
        "c AS (SELECT host, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b FROM j WHERE host <> '' AND ruled IS NOT NULL GROUP BY host)",
        "s0 AS (SELECT host, a / greatest(1, (SELECT sum(a) FROM c))::DOUBLE AS t, b / greatest(1, (SELECT sum(b) FROM c))::DOUBLE AS d FROM c)",
        f"k AS (SELECT source, translate(regexp_extract(link, '//(.*)$', 1), '{UPPER}', '{LOWER}') AS target FROM (SELECT host AS source, unnest(list_distinct(regexp_extract_all(html, '(?i)(?:href|src)\\s*=\\s*[\"'']?\\s*((?:https?:)?//[^/?#\"''\\s>]+)', 1))) AS link FROM u))",
        "e AS (SELECT source, target, count(*)::DOUBLE AS n FROM k WHERE source <> '' AND target <> '' AND source <> target GROUP BY 1, 2)",
        "g AS (SELECT source AS host, target AS next, n / sum(n) OVER (PARTITION BY source) AS wt, 0.0::DOUBLE AS wd FROM e UNION ALL SELECT target, source, 0.0::DOUBLE, n / sum(n) OVER (PARTITION BY target) FROM e)",
    ]
    parts.append(f"w AS (SELECT 0 AS i, host, t, d FROM s0 UNION ALL SELECT i + 1, next, sum(t * wt) * {d}, sum(d * wd) * {d} FROM w JOIN g USING (host) WHERE i < {steps} AND (t > 0 OR d > 0) GROUP BY ALL)")
    parts.append("z AS (SELECT host, sum(t) AS t, sum(d) AS d FROM w GROUP BY host)")
    parts.append("q AS (SELECT host, t / greatest(1e-300, sum(t) OVER ()) AS t, d / greatest(1e-300, sum(d) OVER ()) AS d FROM z)")
    reached = f"(SELECT host, CASE WHEN round((t - d) / (t + d), {decimals}) < 0 THEN 'block' ELSE 'allow' END AS reached FROM q WHERE t + d > 0)"
    return f"WITH RECURSIVE {', '.join(parts)} SELECT page_id, host, path, rule, coalesce(ruled, reached, 'allow') AS verdict FROM j LEFT JOIN {reached} USING (host)"


def crc32(text: str) -> str:
    """SQL for the unsigned crc32 of a text's UTF-8 bytes, by the table of its polynomial."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    h = f"hex(encode({text}))"
    steps = f"list_transform(range(0, length({h}) // 2), lambda i: CAST('0x' || substr({h}, 2 * i + 1, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, b: xor(c >> 8, ({table}::BIGINT[])[CAST(xor(c, b) & 255 AS INTEGER) + 1])))"


def _op11() -> str:
    """A way is one text: cost in nine digits, audit, chr(1), lines each led by a line break; of two ways the least is the better. v0 to v3 are the best ways to the four states."""
    cut = "strpos({v}, chr(1))"

    def go(v: str, cost: str, edit: str, line: str = "''") -> str:
        at = cut.format(v=v)
        return f"lpad(CAST(CAST(substr({v}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({v}, 10, {at} - 10) || '{edit}' || substr({v}, {at}) || {line}"

    def inserted(table: str, name: str, others: str) -> str:
        """``table`` with ways that insert rows: to a user turn, from there to an assistant's, and to a user's again."""
        u = f"least(v2, {', '.join(go(v, '5', 'I', 'chr(10) || ' + repr('user:')) for v in ('v0', 'v1', 'v3'))})"
        a = f"least(v3, {go('v2', '5', 'I', 'chr(10) || ' + repr('assistant:'))})"
        one = f"(SELECT {others}, v0, v1, {u} AS v2, v3 FROM {table})"
        return f"(SELECT {others}, v0, v1, {u} AS v2, v3 FROM (SELECT {others}, v0, v1, v2, {a} AS v3 FROM {one})) {name}"

    line = lambda role: f"chr(10) || {role} || ':' || text"
    keep = lambda v: go(v, "extra", "K", line("role"))
    turn = lambda v, role: go(v, "extra + 1", "R", line(repr(role)))
    when = lambda test, value: f"CASE WHEN {test} THEN {value} END"
    drop = lambda v: go(v, "2", "D")
    to_user = [x for v in ("v0", "v1", "v3") for x in (when("stays AND initial = 'u'", keep(v)), when("stays", turn(v, "user")))]
    to_assistant = [when("stays AND initial = 'a'", keep("v2")), when("stays", turn("v2", "assistant"))]
    step = f"SELECT conv_id, i + 1, {drop('v0')}, least({drop('v1')}, {when(repr('s') + ' = initial AND stays', keep('v0'))}), least({drop('v2')}, {', '.join(to_user)}), least({drop('v3')}, {', '.join(to_assistant)})"
    held = "(SELECT r.conv_id, w.i, w.v0, w.v1, w.v2, w.v3, r.role, r.text, r.initial, r.stays, r.extra FROM w JOIN o r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1)"
    others = "conv_id, i, role, text, initial, stays, extra"
    space, stop = "' \t' || chr(10) || chr(11) || chr(12) || chr(13)", "'.', '!', '?'"
    parts = [
        f"k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32('concat(coalesce(CAST(conv_id AS VARCHAR), chr(32)), chr(58), coalesce(CAST(turn AS VARCHAR), chr(32)))')} % 20 AS kind FROM conversations)",
        "m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0)",
        "n AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM m)",
        f"f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS copies, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before, right(rtrim(text, {space}), 1) AS final FROM n)",
        f"g AS (SELECT *, CASE WHEN final = '' THEN 'blank' WHEN copies > 1 THEN 'duplicate' WHEN final NOT IN ({stop}) THEN 'truncated' ELSE '' END AS fault FROM f)",
        "o AS (SELECT conv_id, i, role, text, initial, fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM g)",
        "c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM g GROUP BY conv_id)",
        f"w AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' || chr(1) AS v0, CAST(NULL AS VARCHAR) AS v1, CAST(NULL AS VARCHAR) AS v2, CAST(NULL AS VARCHAR) AS v3 FROM c UNION ALL {step} FROM {inserted(held, 'h', others)})",
        f"e AS (SELECT conv_id, least(v0, v3) AS v FROM {inserted('(SELECT w.* FROM w JOIN c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i)', 'h', 'conv_id, i')})",
        f"z AS (SELECT conv_id, CAST(substr(v, 1, 9) AS BIGINT) AS cost, substr(v, 10, {cut.format(v='v')} - 10) AS audit, sha256(substr(v, {cut.format(v='v')} + 2)) AS repaired_sha256 FROM e)",
        "d AS (SELECT DISTINCT conv_id FROM conversations)",
    ]
    counts = ", ".join(f"coalesce({x}, 0) AS {x}" for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return f"WITH RECURSIVE {', '.join(parts)} SELECT d.conv_id, {counts}, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256 FROM d LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM d.conv_id"


OP11 = _op11()

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP12 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), t AS (SELECT {_WORDS} AS ws FROM benchmark),
v AS (SELECT w, {crc32('w')} % 10000 AS b FROM (SELECT DISTINCT w FROM (SELECT unnest(ws) AS w FROM d UNION ALL SELECT unnest(ws) FROM t))),
s AS (SELECT b, count(*) AS s FROM (SELECT unnest(ws) AS w FROM d) JOIN v USING (w) GROUP BY b),
g AS (SELECT b, count(*) AS t FROM (SELECT unnest(ws) AS w FROM t) JOIN v USING (w) GROUP BY b),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS ns, (SELECT coalesce(sum(t), 0) FROM g)::DOUBLE AS nt),
x AS (SELECT w, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (ns + 10000)) / ((coalesce(s, 0) + 1)::DOUBLE * (nt + 10000)))) AS BIGINT) AS gain FROM v LEFT JOIN s USING (b) LEFT JOIN g USING (b) CROSS JOIN n),
y AS (SELECT doc_id, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM (SELECT doc_id, unnest(ws) AS w FROM d) JOIN x USING (w) GROUP BY doc_id),
z AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM documents LEFT JOIN y USING (doc_id)),
q AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM z),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM q WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM q LEFT JOIN r USING (doc_id)
"""
