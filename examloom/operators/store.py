"""The record store as append-only tables (S6-S10, J32-J34, J45, P8, P12-P14, P25, P34, A24, L3, L4, M1, M8-M16, W14). Writers that share a table are in ``keyed_log`` and ``overlays``, folders and tallies in ``outcomes``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_artifacts(artifacts: DataFrame) -> DataFrame:
    """The oldest of each run and kind."""
    return artifacts.groupBy("run_id", "kind").agg(F.min_by("path", F.struct("created_at", "seq")).alias("path"), F.count("*").alias("copies"))


def latest_artifacts(artifacts: DataFrame) -> DataFrame:
    """M1: the current one of each run and kind."""
    return artifacts.groupBy("run_id", "kind").agg(F.max_by("path", F.struct("created_at", "seq")).alias("path"), F.count("*").alias("copies"))


def scan(artifacts: DataFrame, run_id: int, kind: str) -> DataFrame:
    """One run's artifacts of a kind, oldest first."""
    return artifacts.filter((F.col("run_id") == run_id) & (F.col("kind") == kind)).orderBy("created_at", "seq")


def resumable(runs: DataFrame) -> DataFrame:
    """P12."""
    return runs.filter(F.col("status").isin("running", "paused"))


def history(runs: DataFrame, folder_jobs: DataFrame) -> DataFrame:
    """Finished runs of jobs that are no folders, the newest of each job first."""
    order = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("created_at"), F.desc("run_id")))
    return runs.filter("status = 'done'").join(folder_jobs, "job_id", "left_anti").withColumn("place", order)


def restorable(jobs: DataFrame, runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(kind, restored, skipped): runs need their job, artifacts a restored run."""
    r = runs.join(jobs.select("job_id", F.lit(1).alias("ok")).distinct(), "job_id", "left")
    good = r.filter("ok = 1").select("run_id", F.lit(1).alias("ok"))
    a = artifacts.select("run_id").join(good, "run_id", "left")
    tally = lambda df, name: df.agg(F.lit(name).alias("kind"), F.count("ok").alias("restored"), F.count_if(F.col("ok").isNull()).alias("skipped"))
    return tally(r, "runs").unionByName(tally(a, "artifacts"))


def survivors(runs: DataFrame, artifacts: DataFrame, deleted_jobs: DataFrame) -> DataFrame:
    """M9: artifacts that are left per kind after jobs are deleted with all that hangs on them."""
    gone = runs.join(deleted_jobs, "job_id", "left_semi").select("run_id")
    return artifacts.join(gone, "run_id", "left_anti").groupBy("kind").agg(F.count("*").alias("n"))


def current(log: DataFrame, *key: str) -> DataFrame:
    """M2-M7: the last entry of each key in an append-only overlay; entries with ``deleted`` are tombstones."""
    last = log.groupBy(*key).agg(F.max_by(F.struct(*(c for c in log.columns if c not in key)), "seq").alias("last"))
    return last.select(*key, "last.*").filter(~F.coalesce("deleted", F.lit(False)))


def restored(own: DataFrame, backup: DataFrame, key: str) -> DataFrame:
    """Backup rows over own rows with the same key; doing it again changes nothing."""
    both = own.withColumn("from_backup", F.lit(0)).unionByName(backup.withColumn("from_backup", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(F.struct(*(c for c in own.columns if c != key)), "from_backup").alias("row")).select(key, "row.*")


def backups_to_drop(files: DataFrame, keep: int = 5) -> DataFrame:
    """Automatic backups but the newest by name."""
    n = F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("name")))
    return files.filter(F.col("name").startswith("auto-")).withColumn("n", n).filter(F.col("n") > keep).drop("n")


#: Kinds of artifacts that a backup of the work holds, what one of everything holds besides, and stop reasons that may be tried again.
WORK_KINDS = (
    "blueprint-valid", "merged-rows", "csv", "audit-report", "review-resolutions", "review-edits", "review-deletions", "review-additions", "ai-answers", "topics-list", "topic-matches", "agent-report", "crop",
)
PAGE_KINDS = ("page-jpeg", "page-text")
RETRYABLE = ("billing-required", "invalid-request", "model-unavailable", "temporarily-unavailable", "provider-error", "unexpected_error")
ACTIVE = ("running", "paused")


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """Appends to a store of Parquet folders by kind, so that a scan of one kind reads that folder only."""
    artifacts.write.mode("append").partitionBy("kind").parquet(path)


def at_index(artifacts: DataFrame, run_id: int, kind: str, index: int) -> DataFrame:
    """The oldest artifact of a run, kind and page_index."""
    return artifacts.filter((F.col("run_id") == run_id) & (F.col("kind") == kind) & (F.col("page_index") == index)).orderBy("created_at", "seq").limit(1)


def at_path(artifacts: DataFrame, kind: str, paths: DataFrame) -> DataFrame:
    """Artifacts of a kind whose path is one of ``paths`` (run_id, path)."""
    return artifacts.filter(F.col("kind") == kind).join(paths.select("run_id", "path").distinct(), ["run_id", "path"], "left_semi")


def in_scope(artifacts: DataFrame, everything: bool = False) -> DataFrame:
    """P25."""
    return artifacts.filter(F.col("kind").isin(*WORK_KINDS, *(PAGE_KINDS if everything else ())))


def whole_records(records: DataFrame, *needed: str) -> DataFrame:
    """Records with an id that is not empty, and with all of ``needed``."""
    ok = F.coalesce(F.col("id") != "", F.lit(False))
    for c in needed:
        ok = ok & F.col(c).isNotNull()
    return records.filter(ok)


def without_artifacts(artifacts: DataFrame, cleared: DataFrame) -> DataFrame:
    """M8: what is left when ``cleared`` (run_id, kind, chunk) goes; a null chunk clears all chunks of a kind."""
    both = ["run_id", "kind"]
    left = artifacts.join(cleared.filter("chunk is null").select(*both).distinct(), both, "left_anti")
    return left.join(cleared.filter("chunk is not null").select(*both, "chunk").distinct(), [*both, "chunk"], "left_anti")


def archived(jobs: DataFrame, runs: DataFrame, files: DataFrame, at_startup: bool = False) -> tuple[DataFrame, DataFrame]:
    """(runs, files) when each current job of ``jobs`` (job_id, archive_id, keep_original) is archived and starts anew.

    Its runs move to archive_id; its files move along if keep_original, else they go, and they go in any case where there is no run. At startup, a
    job with active runs stays as it is.
    """
    state = runs.groupBy("job_id").agg(F.count("*").alias("n"), F.bool_or(F.col("status").isin(*ACTIVE)).alias("active"))
    todo = jobs.join(state, "job_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    todo = todo.filter("n > 0 and not active") if at_startup else todo
    todo = todo.select("job_id", "archive_id", "keep_original", "n")
    moved = runs.join(todo.select("job_id", "archive_id"), "job_id", "left").withColumn("job_id", F.coalesce("archive_id", "job_id")).select(*runs.columns)
    kept = files.join(todo, "job_id", "left").filter(F.col("n").isNull() | (F.col("keep_original") & (F.col("n") > 0)))
    return moved, kept.withColumn("job_id", F.coalesce("archive_id", "job_id")).select(*files.columns)


def restore_outcomes(runs: DataFrame, files: DataFrame, current: DataFrame) -> DataFrame:
    """(run_id, outcome): missing-original for a run of a current job or without its file, current-not-empty where the owner's current job has a
    run or a file, else restored. ``runs``: run_id, job_id, owner, file_id; ``files``: file_id, job_id, owner; ``current``: owner, job_id.
    """
    now = current.select("owner", F.col("job_id").alias("now"))
    held = runs.select("owner", "job_id").unionByName(files.select("owner", "job_id")).join(current, ["owner", "job_id"], "left_semi").select("owner", F.lit(True).alias("busy")).distinct()
    r = runs.join(now, "owner", "left").join(held, "owner", "left").join(files.select("file_id", F.lit(True).alias("there")).distinct(), "file_id", "left")
    missing = F.coalesce(F.col("job_id") == F.col("now"), F.lit(False)) | F.col("there").isNull()
    return r.select("run_id", F.when(missing, "missing-original").when(F.col("busy"), "current-not-empty").otherwise("restored").alias("outcome"))


def replaced(files: DataFrame, new: DataFrame, kind: str, *key: str) -> DataFrame:
    """``new`` files of a kind in place of the old ones with the same ``key``: at most one answer key of an exam, or topics document of a job."""
    last = new.groupBy(*key).agg(F.max_by(F.struct(*(c for c in new.columns if c not in key)), "added_at").alias("f")).select(*key, "f.*")
    old = files.filter(F.col("kind") == kind).join(new.select(*key).distinct(), [*key], "left_anti")
    return files.filter(F.col("kind") != kind).unionByName(old.select(*files.columns)).unionByName(last.select(*files.columns))


def with_sources(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """A file's new source (file_id, new_source), trimmed, is that of all its runs."""
    return runs.join(sources, "file_id", "left").withColumn("source", F.coalesce(F.trim("new_source"), "source")).select(*runs.columns)


def stopped(runs: DataFrame, reason: str) -> DataFrame:
    """Active runs become stopped, with a reason."""
    active = F.col("status").isin(*ACTIVE)
    return runs.withColumn("stop_reason", F.when(active, F.lit(reason)).otherwise(F.col("stop_reason"))).withColumn("status", F.when(active, "stopped").otherwise(F.col("status")))


def without_topics(artifacts: DataFrame, runs: DataFrame) -> DataFrame:
    """Excluded finished runs lose their topic lists and matches."""
    out = runs.filter("status = 'done' and excluded").select("run_id").distinct().withColumn("kind", F.explode(F.array(F.lit("topics-list"), F.lit("topic-matches"))))
    return artifacts.join(out, ["run_id", "kind"], "left_anti")


def retryable(runs: DataFrame) -> DataFrame:
    """Stopped runs whose reason may pass."""
    return runs.filter((F.col("status") == "stopped") & F.col("stop_reason").isin(*RETRYABLE))


def batches(runs: DataFrame) -> DataFrame:
    """Per job, whether a run is active, how many are exportable, and its newest finished run (the first of equals by run_id)."""
    done = F.col("status") == "done"
    newest = F.max_by(F.when(done, F.col("run_id")), F.when(done, F.struct("created_at", -F.col("run_id"))))
    return runs.groupBy("job_id").agg(F.bool_or(F.col("status").isin(*ACTIVE)).alias("is_running"), F.count_if(done).alias("exportable"), newest.alias("newest_done"), F.count("*").alias("runs"))


def answer_keys(exams: DataFrame, keys: DataFrame) -> DataFrame:
    """(file_id, key_id): the pinned key of an exam if it exists, else the first that names it as its parent. ``exams``: file_id, pinned."""
    k = keys.filter("kind = 'answer-key'")
    linked = k.groupBy(F.col("parent_id").alias("file_id")).agg(F.min_by("file_id", F.struct("added_at", "file_id")).alias("linked"))
    pinned = k.select(F.col("file_id").alias("pinned"), F.lit(True).alias("there"))
    # Exams that pin nothing stay out of the join: they would all meet in one task, under null.
    fixed = exams.filter("pinned is not null").join(pinned, "pinned", "left").select("file_id", F.when(F.col("there"), F.col("pinned")).alias("fixed"))
    free = exams.filter("pinned is null").select("file_id", F.col("pinned").alias("fixed"))
    return fixed.unionByName(free).join(linked, "file_id", "left").select("file_id", F.coalesce("fixed", "linked").alias("key_id"))


def matching_targets(runs: DataFrame) -> DataFrame:
    """Finished runs with what happens to them: matched, or cleared if they are excluded."""
    return runs.filter("status = 'done'").select("job_id", "run_id", F.when(F.coalesce("excluded", F.lit(False)), "clear").otherwise("match").alias("action"))


def by_age(rows: DataFrame, key: str, at: str, newest_first: bool = False) -> DataFrame:
    """L3, L4: ``place`` of each row of a ``key`` by time, equal times in the order of their ids."""
    order = F.desc(at) if newest_first else F.asc(at)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order, "id")))
