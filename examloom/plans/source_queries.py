"""Queries over shared logs, exams as lines, chunks tried in halves, and streams over the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examloom import rounds
from examloom.operators.overlays import ANSWER, EDIT, RESOLUTION, Overlays
from examloom.plans.catalogue import Tables, query
from examloom.sources import exams
from examloom.sources import relations as rel
from examloom.storage import shared_dir
from examloom.streaming import ordered
from examloom.streaming import telemetry as streams

#: One text for both engines: the lines of a row of V1. Banners, page numbers, decoys, continued lines, options on one line or on four, headers.
_LINES = """array(CASE WHEN pos % 3 = 1 THEN '=== PAGE ' || CAST(pos DIV 3 + 1 AS STRING) || ' ===' ELSE '' END, CASE WHEN pos % 3 = 2 THEN ' ' || CAST(pos DIV 3 + 1 AS STRING) ELSE '' END, CASE WHEN pos % 5 = 0 THEN 'a line 0610/12' ELSE '' END,
CASE WHEN doc_id % 9 = 0 THEN CAST(pos + 500 AS STRING) || ' decoy' ELSE CAST(n AS STRING) || '  ' || id || ' has  words' END, CASE WHEN doc_id % 4 = 0 THEN 'a second  line' ELSE '' END, CASE WHEN doc_id % 2 = 0 THEN 'A one B two ' || id || ' C three D four' ELSE 'A first' END,
CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'B second ' || id END, CASE WHEN doc_id % 7 = 0 THEN 'goes on' ELSE '' END)"""
_DUCK_LINES = _LINES.replace("array(", "list_value(").replace("DIV", "//")


@query(
    rf"""RECURSIVE, v AS (SELECT *, count(*) FILTER (doc_id % 9 <> 0) OVER (PARTITION BY run_id ORDER BY pos) AS n FROM exam_rows), u AS (SELECT run_id AS file, pos, unnest({_DUCK_LINES}) AS x, generate_subscripts({_DUCK_LINES}, 1) AS k FROM v),
    l AS (SELECT file, trim(x) AS x, row_number() OVER (PARTITION BY file ORDER BY pos, k) AS i FROM u WHERE trim(x) <> ''),
    w AS (SELECT DISTINCT file, CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS page, CAST(1 AS BIGINT) AS want, '' AS kind, '' AS x FROM l UNION ALL SELECT l.file, l.i, CASE WHEN regexp_matches(l.x, '^=== PAGE [0-9]+ ===$') THEN CAST(regexp_extract(l.x, '([0-9]+)', 1) AS BIGINT) ELSE page END,
        want + CASE WHEN regexp_matches(l.x, '^[0-9]+\s+.') AND regexp_extract(l.x, '^([0-9]+)', 1) = CAST(want AS VARCHAR) THEN 1 ELSE 0 END,
        CASE WHEN regexp_matches(l.x, '^=== PAGE [0-9]+ ===$') OR contains(l.x, '0610/12') OR l.x = CAST(page AS VARCHAR) THEN 'skip' WHEN regexp_matches(l.x, '^[0-9]+\s+.') AND regexp_extract(l.x, '^([0-9]+)', 1) = CAST(want AS VARCHAR) THEN 'start'
            WHEN regexp_matches(l.x, '^A\s+.+\s+B\s+.+\s+C\s+.+\s+D\s+.+$') THEN 'four' WHEN regexp_matches(l.x, '^[A-D]\s+.') THEN 'option' ELSE 'more' END, l.x FROM w JOIN l ON l.file = w.file AND l.i = w.i + 1),
    c AS (SELECT file, i, page, want - 1 AS number, kind, regexp_replace(x, '[ \t]+', ' ', 'g') AS x FROM w WHERE kind NOT IN ('', 'skip') AND want > 1),
    q AS (SELECT file, number, any_value(page) FILTER (kind = 'start') AS page, list(struct_pack(kind := kind, x := x) ORDER BY i) AS ls FROM c GROUP BY 1, 2),
    f AS (SELECT file, number, page, list_reduce(list_transform(ls, lambda s: struct_pack(kind := s.kind, q := CASE WHEN s.kind = 'start' THEN regexp_replace(s.x, '^[0-9]+ ', '') ELSE s.x END, o := CAST([] AS VARCHAR[]))), lambda a, b: struct_pack(kind := '',
        q := CASE WHEN b.kind = 'more' AND len(a.o) = 0 THEN a.q || chr(10) || b.q ELSE a.q END,
        o := CASE WHEN b.kind = 'four' THEN [{", ".join(f"regexp_extract(b.q, '^A (.+?) B (.+?) C (.+?) D (.+)$', {k})" for k in range(1, 5))}] WHEN b.kind = 'option' THEN list_append(a.o, b.q[3:])
            WHEN len(a.o) > 0 THEN list_append(a.o[:-2], a.o[-1] || ' ' || b.q) ELSE a.o END)) AS r FROM q)
    SELECT file, number, page, r.q AS question, array_to_string(r.o, '|') AS options FROM f""",
    "exam_rows",
)
def exam_line_questions(t: Tables) -> DataFrame:
    numbered = t.v1.filter("doc_id % 9 <> 0").select("run_id", "doc_id")
    n = rel.positions(numbered.withColumnRenamed("run_id", "source")).select("doc_id", F.col("pos").alias("n"))
    lines = t.v1.join(n, "doc_id", "left").select(F.col("run_id").alias("file"), "pos", F.posexplode(F.expr(_LINES)).alias("k", "text")).select("file", (F.col("pos") * 100 + F.col("k")).alias("line"), "text")
    return exams.parsed_exam(lines).select("file", "number", "page", "question", F.array_join("options", "|").alias("options"))


@query(
    """RECURSIVE, r AS (SELECT run_id || '/' || CAST(pos // 10 AS VARCHAR) AS chunk, id, doc_id % 11 = 0 AS bad, row_number() OVER (PARTITION BY run_id, pos // 10 ORDER BY pos) - 1 AS i FROM exam_rows), c AS (SELECT chunk, list(bad ORDER BY i) AS b, count(*) AS n FROM r GROUP BY 1),
    p AS (SELECT chunk, b, CAST(0 AS BIGINT) AS lo, n AS hi FROM c UNION ALL SELECT chunk, b, CASE WHEN h = 0 THEN lo ELSE lo + (hi - lo + 1) // 2 END, CASE WHEN h = 0 THEN lo + (hi - lo + 1) // 2 ELSE hi END FROM (SELECT *, unnest([0, 1]) AS h FROM p WHERE hi - lo > 1 AND list_contains(list_slice(b, lo + 1, hi), true)))
    SELECT r.id, CAST(lo AS INT) AS lo, CAST(hi - 1 AS INT) AS hi, bad AS failed FROM r JOIN p ON p.chunk = r.chunk AND r.i >= lo AND r.i < hi WHERE hi - lo = 1 OR NOT list_contains(list_slice(p.b, lo + 1, hi), true)""",
    "exam_rows",
)
def bisected_chunks(t: Tables) -> DataFrame:
    chunk = F.concat("run_id", F.lit("/"), F.expr("string(pos div 10)"))
    done, failed = rounds.bisected(t.v1.select(chunk.alias("chunk"), "pos", "id", (F.col("doc_id") % 11 == 0).alias("bad")), lambda some: some.filter("bad").select("piece"))
    return done.unionByName(failed).select("id", "piece.lo", "piece.hi", F.col("bad").alias("failed"))


@query(
    """, e AS (SELECT run_id, id, CAST(pick AS VARCHAR) AS pick FROM exam_rows JOIN picks USING (doc_id)), k AS (SELECT run_id, id, CASE WHEN CAST(id AS BIGINT) % 4 <> 1 THEN pick WHEN pick IN ('0', '1') THEN CAST(1 - CAST(pick AS INT) AS VARCHAR) END AS pick FROM e WHERE CAST(id AS BIGINT) % 5 <> 0), x AS (SELECT run_id, CAST(e.doc_id AS VARCHAR) AS id, new_question, new_topic FROM edits e JOIN exam_rows USING (doc_id)),
    a AS (SELECT run_id, id, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 3 = 1 THEN 0 END AS VARCHAR) AS v FROM exam_rows WHERE doc_id % 4 = 1)
    SELECT 'resolution' AS kind, run_id, id AS row_id, pick AS value FROM k WHERE pick IS NOT NULL UNION ALL SELECT 'edit', run_id, id, 'year=2024' || CASE WHEN new_topic IS NULL THEN '' ELSE ',topic=' || new_topic END FROM x UNION ALL SELECT 'answer', run_id, id, v FROM a WHERE v IS NOT NULL""",
    "exam_rows", "picks", "edits",
)
def overlay_state(t: Tables) -> DataFrame:
    """Decisions written in several steps, over and over, as they stand in the end."""
    o = Overlays(t._spark, f"{shared_dir(t._spark)}/overlays-{uuid.uuid4().hex}")
    rows = t.v1.select("run_id", F.col("id").alias("row_id"), "doc_id")
    picks = rows.join(t.picks, "doc_id")
    o.resolve(picks.select("run_id", "row_id", F.lit(9).alias("pick")))
    o.resolve(picks.select("run_id", "row_id", "pick"))
    o.clear(RESOLUTION, picks.filter("doc_id % 5 = 0"))
    edited = rows.join(t.edits, "doc_id")
    o.edit(edited.select("run_id", "row_id", F.create_map(F.lit("question"), F.col("new_question"), F.lit("topic"), F.coalesce("new_topic", F.lit(""))).alias("fields")))
    o.edit(edited.select("run_id", "row_id", F.create_map(F.lit("question"), F.lit(" "), F.lit("year"), F.lit("2024")).alias("fields")))
    some = rows.filter("doc_id % 4 = 1")
    o.answer(some.select("run_id", "row_id", (F.col("doc_id") % 3).alias("answer")))
    o.remap(some.select("run_id", "row_id", F.array(*map(F.lit, "abc")).alias("before"), F.array(*map(F.lit, "ba")).alias("after")))
    fields = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    value = F.when(F.col("kind") == EDIT, F.array_join(F.reverse(F.split(fields, ",")), ",")).otherwise(F.col("value"))
    return o.log.current().filter(F.col("kind").isin(RESOLUTION, EDIT, ANSWER)).select("kind", "run_id", "row_id", value.alias("value"))


def _streamed(t: Tables, build) -> DataFrame:
    """All that a stream over the event table tells until its watermark is where the table ends."""
    spark, name = t._spark, "spark.sql.streaming.stateStore.providerClass"
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    log = rel.log_events(spark.readStream.schema(t.events.schema).parquet(f"{t._dir}/events.parque[t]"))
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = build(log)
        q = out.writeStream.format("parquet").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start(f"{place}/out")
        q.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(out.schema).parquet(f"{place}/out")


#: The watermark counts in milliseconds.
_PASSED = "epoch_us(t) <= (SELECT max(epoch_us(t)) // 1000 * 1000 FROM log) - 600000000"


@query(f""", w AS (SELECT run_id, seq, t, count(*) OVER (PARTITION BY run_id ORDER BY t RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS recent, (epoch_us(t) - epoch_us(lag(t) OVER (PARTITION BY run_id ORDER BY t, seq))) / 1000000.0::DOUBLE AS gap_s FROM log)
    SELECT run_id, seq, recent, round(gap_s, 6) AS gap_s FROM w WHERE {_PASSED}""", "log")  # fmt: skip
def stream_rate_window(t: Tables) -> DataFrame:
    return _streamed(t, lambda log: ordered.rate_window(log, 3600)).withColumn("gap_s", F.round("gap_s", 6))


@query(f""", i AS (SELECT *, sum(CASE WHEN event <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY t, seq) AS isl FROM log), s AS (SELECT run_id, seq, t, event, sum(CASE WHEN event = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, isl ORDER BY t, seq) AS k FROM i)
    SELECT run_id, seq, CAST(k AS BIGINT) AS streak, k >= 3 AS demoted FROM s WHERE event = 'error' AND {_PASSED}""", "log")  # fmt: skip
def stream_failure_streaks(t: Tables) -> DataFrame:
    return _streamed(t, ordered.failure_streaks)


@query("SELECT run_id, seq FROM (SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS k FROM log) WHERE k <= 20", "log")
def stream_newest(t: Tables) -> DataFrame:
    changes = _streamed(t, lambda log: ordered.newest(log, 20))
    return changes.groupBy("run_id", "seq").agg(F.sum(F.when(F.col("change") == "kept", 1).otherwise(-1)).alias("n")).filter("n > 0").select("run_id", "seq")


@query("""SELECT CAST(t AS DATE) AS day, CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END AS model, count(*) AS requests, greatest(0, 500 - count(*)) AS "left" FROM log
    WHERE CAST(t AS DATE) + INTERVAL 1 DAY <= (SELECT max(t) FROM log) - INTERVAL 1 DAY GROUP BY 1, 2""", "log")  # fmt: skip
def stream_daily_quota(t: Tables) -> DataFrame:
    return _streamed(t, streams.daily_quota)
