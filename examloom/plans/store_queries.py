"""Queries over the record store: runs from orders, artifacts from lineitem, files for each run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examloom.operators import store
from examloom.plans.catalogue import Tables, query
from examloom.sources.relations import pick

_REASONS = ("billing-required", "wrong-key", "model-unavailable", "user", "provider-error", "quota")
_STATES = "run_state AS (SELECT runs.*, CASE WHEN status = 'paused' THEN 'stopped' ELSE status END AS state, CASE run_id % 6 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_REASONS)) + " END AS reason FROM runs)"
_FILES = """, files_ AS (SELECT run_id AS file_id, job_id, 'exam' AS kind, CAST(NULL AS BIGINT) AS parent_id, created_at AS added_at FROM runs WHERE run_id % 7 <> 0
UNION ALL SELECT run_id + 1000000000, job_id, 'answer-key', run_id, created_at FROM runs WHERE run_id % 3 = 0 UNION ALL SELECT run_id + 2000000000, job_id, 'answer-key', run_id, created_at FROM runs WHERE run_id % 6 = 0)"""


def _files(t: Tables) -> DataFrame:
    r = t.runs
    key = lambda n, every: r.filter(F.col("run_id") % every == 0).select((F.col("run_id") + n).alias("file_id"), "job_id", F.lit("answer-key").alias("kind"), F.col("run_id").alias("parent_id"), F.col("created_at").alias("added_at"))
    exams = r.filter("run_id % 7 <> 0").select(F.col("run_id").alias("file_id"), "job_id", F.lit("exam").alias("kind"), F.lit(None).cast("long").alias("parent_id"), F.col("created_at").alias("added_at"))
    return exams.unionByName(key(1_000_000_000, 3)).unionByName(key(2_000_000_000, 6))


@query("SELECT kind, count(*) AS n FROM (SELECT l_orderkey AS run_id, l_returnflag AS kind, l_linenumber AS chunk FROM lineitem) a WHERE NOT (kind = 'R' AND run_id % 5 = 0) AND NOT (kind = 'A' AND run_id % 4 = 0 AND chunk = 1) GROUP BY 1")
def artifacts_cleared(t: Tables) -> DataFrame:
    a = t.lineitem.select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("chunk"))
    whole = a.filter("run_id % 5 = 0").select("run_id", F.lit("R").alias("kind"), F.lit(None).cast("int").alias("chunk"))
    return store.without_artifacts(a, whole.unionByName(a.filter("run_id % 4 = 0").select("run_id", F.lit("A").alias("kind"), F.lit(1).alias("chunk")))).groupBy("kind").agg(F.count("*").alias("n"))


_ARCHIVES = ", b AS (SELECT job_id, bool_or(status IN ('running', 'paused')) AS active FROM runs GROUP BY 1)"


@query(f"{_ARCHIVES} SELECT run_id, CAST(CASE WHEN job_id % 10 = 0 AND NOT active THEN job_id + 1000000000 ELSE job_id END AS BIGINT) AS job_id FROM runs JOIN b USING (job_id)", "runs")
def archived_runs(t: Tables) -> DataFrame:
    return store.archived(_current(t), t.runs, _files(t), at_startup=True)[0].select("run_id", "job_id")


@query(
    f"""{_FILES}{_ARCHIVES} SELECT file_id, CAST(CASE WHEN job_id % 10 = 0 AND active IS NOT NULL THEN job_id + 1000000000 ELSE job_id END AS BIGINT) AS job_id FROM files_ LEFT JOIN b USING (job_id)
    WHERE NOT (job_id % 10 = 0 AND job_id % 20 = 0)""",
    "runs",
)
def archived_files(t: Tables) -> DataFrame:
    return store.archived(_current(t), t.runs, _files(t))[1].select("file_id", "job_id")


def _current(t: Tables) -> DataFrame:
    return t.customer.filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("job_id"), (F.col("c_custkey") + 1_000_000_000).alias("archive_id"), (F.col("c_custkey") % 20 != 0).alias("keep_original"))


@query(
    f"""{_FILES} SELECT run_id, CASE WHEN job_id % 10 = 0 OR run_id % 7 = 0 THEN 'missing-original' WHEN job_id % 50 IN (SELECT job_id % 50 FROM runs WHERE job_id % 10 = 0 UNION SELECT job_id % 50 FROM files_ WHERE job_id % 10 = 0) THEN 'current-not-empty' ELSE 'restored' END AS outcome FROM runs""",
    "runs",
)
def restore_outcomes(t: Tables) -> DataFrame:
    owner = (F.col("job_id") % 50).alias("owner")
    # An owner may have several current jobs here: each is one.
    current = t.customer.filter("c_custkey % 10 = 0").select((F.col("c_custkey") % 50).alias("owner"), F.col("c_custkey").alias("job_id"))
    runs = t.runs.select("run_id", "job_id", owner, F.col("run_id").alias("file_id"))
    # A run of any current job is missing; the others are judged by what their owner's current jobs hold.
    of_current = runs.join(current, ["owner", "job_id"], "left_semi").select("run_id", F.lit("missing-original").alias("outcome"))
    rest = runs.join(current, ["owner", "job_id"], "left_anti")
    held = runs.join(current, ["owner", "job_id"], "left_semi").select("owner", F.lit(-1).cast("long").alias("job_id")).distinct()
    one = current.select("owner", F.lit(-1).cast("long").alias("job_id")).distinct()
    files = _files(t).select("file_id", F.when(F.col("job_id") % 10 == 0, -1).otherwise(F.col("job_id")).alias("job_id"), (F.col("job_id") % 50).alias("owner"))
    busy = held.select(F.lit(-1).cast("long").alias("run_id"), "job_id", "owner", F.lit(-1).cast("long").alias("file_id"))
    return store.restore_outcomes(rest.select("run_id", "job_id", "owner", "file_id").unionByName(busy), files, one).filter("run_id >= 0").unionByName(of_current)


@query(f"{_FILES} SELECT count(*) AS n, count(*) FILTER (kind = 'answer-key') AS answer_keys, count(*) FILTER (file_id >= 3000000000) AS replaced FROM (SELECT kind, file_id FROM files_ WHERE NOT (kind = 'answer-key' AND parent_id % 12 = 0) UNION ALL SELECT 'answer-key', run_id + 3000000000 FROM runs WHERE run_id % 12 = 0)", "runs")
def replaced_keys(t: Tables) -> DataFrame:
    new = t.runs.filter("run_id % 12 = 0").select((F.col("run_id") + 3_000_000_000).alias("file_id"), "job_id", F.lit("answer-key").alias("kind"), F.col("run_id").alias("parent_id"), F.col("created_at").alias("added_at"))
    older = new.withColumn("file_id", F.col("file_id") + 1_000_000_000).withColumn("added_at", F.col("added_at") - F.expr("interval 1 day"))
    out = store.replaced(_files(t), new.unionByName(older), "answer-key", "parent_id")
    return out.agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "answer-key").alias("answer_keys"), F.count_if(F.col("file_id") >= 3_000_000_000).alias("replaced"))


@query("SELECT run_id, CASE WHEN run_id % 9 = 0 THEN 'new' WHEN run_id % 2 = 0 THEN 'old' ELSE '' END AS source FROM runs", "runs")
def source_propagation(t: Tables) -> DataFrame:
    runs = t.runs.select("run_id", F.col("run_id").alias("file_id"), F.when(F.col("run_id") % 2 == 0, "old").otherwise("").alias("source"))
    return store.with_sources(runs, runs.filter("run_id % 9 = 0").select("file_id", F.lit(" new ").alias("new_source"))).select("run_id", "source")


@query("SELECT run_id, CASE WHEN status = 'done' THEN status ELSE 'stopped' END AS status, CASE WHEN status = 'done' THEN '' ELSE 'user' END AS stop_reason FROM runs", "runs")
def stopped_runs(t: Tables) -> DataFrame:
    return store.stopped(t.runs.withColumn("stop_reason", F.lit("")), "user").select("run_id", "status", "stop_reason")


@query(f", {_STATES} SELECT run_id, reason FROM run_state WHERE state = 'stopped' AND run_id % 6 IN (0, 2, 4)", "runs")
def retryable_runs(t: Tables) -> DataFrame:
    state = F.when(F.col("status") == "paused", "stopped").otherwise(F.col("status"))
    return store.retryable(t.runs.withColumn("status", state).withColumn("stop_reason", pick(F.col("run_id") % 6, *_REASONS))).select("run_id", F.col("stop_reason").alias("reason"))


@query("SELECT job_id, bool_or(status IN ('running', 'paused')) AS is_running, count(*) FILTER (status = 'done') AS exportable, (SELECT r.run_id FROM runs r WHERE r.job_id = x.job_id AND r.status = 'done' ORDER BY r.created_at DESC, r.run_id LIMIT 1) AS newest_done, count(*) AS runs FROM runs x GROUP BY job_id", "runs")
def batch_states(t: Tables) -> DataFrame:
    return store.batches(t.runs)


@query(f"{_FILES} SELECT run_id AS file_id, CASE WHEN run_id % 4 = 0 AND run_id % 6 = 0 THEN run_id + 2000000000 WHEN run_id % 3 = 0 THEN run_id + 1000000000 END AS key_id FROM runs WHERE run_id % 7 <> 0", "runs")
def answer_key_of_exam(t: Tables) -> DataFrame:
    exams = t.runs.filter("run_id % 7 <> 0").select(F.col("run_id").alias("file_id"), F.when(F.col("run_id") % 4 == 0, F.col("run_id") + 2_000_000_000).alias("pinned"))
    return store.answer_keys(exams, _files(t))


@query("SELECT job_id, run_id, CASE WHEN run_id % 4 = 0 THEN 'clear' ELSE 'match' END AS action FROM runs WHERE status = 'done'", "runs")
def matching_targets(t: Tables) -> DataFrame:
    return store.matching_targets(t.runs.withColumn("excluded", F.col("run_id") % 4 == 0))


_KINDS = "CASE l_linenumber % 4 WHEN 0 THEN 'topics-list' WHEN 1 THEN 'topic-matches' WHEN 2 THEN 'page-jpeg' ELSE 'csv' END"


def _kinds(t: Tables) -> DataFrame:
    n = F.col("l_linenumber") % 4
    return t.lineitem.select(F.col("l_orderkey").alias("run_id"), pick(n, "topics-list", "topic-matches", "page-jpeg", default="csv").alias("kind"))


@query(f"SELECT kind, count(*) AS n FROM (SELECT l_orderkey, {_KINDS} AS kind FROM lineitem) WHERE kind <> 'page-jpeg' GROUP BY 1")
def work_artifacts(t: Tables) -> DataFrame:
    return store.in_scope(_kinds(t)).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"SELECT kind, count(*) AS n FROM (SELECT l_orderkey AS run_id, {_KINDS} AS kind FROM lineitem) a LEFT JOIN runs USING (run_id) WHERE NOT (kind IN ('topics-list', 'topic-matches') AND coalesce(status = 'done' AND run_id % 4 = 0, false)) GROUP BY 1", "runs")
def topics_cleared(t: Tables) -> DataFrame:
    return store.without_topics(_kinds(t), t.runs.withColumn("excluded", F.col("run_id") % 4 == 0)).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT run_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, run_id) AS INT) AS place FROM runs", "runs")
def newest_first(t: Tables) -> DataFrame:
    return store.by_age(t.runs.withColumn("id", F.col("run_id")), "job_id", "created_at", newest_first=True).select("run_id", "place")


@query("SELECT count(*) AS records FROM conversations WHERE turn > 0 AND role <> 'system'")
def restorable_records(t: Tables) -> DataFrame:
    r = t.conversations.select(F.when(F.col("turn") == 0, "").otherwise(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("id"), F.when(F.col("role") != "system", F.col("role")).alias("job_id"))
    return store.whole_records(r, "job_id").agg(F.count("*").alias("records"))
