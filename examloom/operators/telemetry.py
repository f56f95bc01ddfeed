"""Progress, quotas, timings and the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The steps of a run and their share of its progress.
STEPS = (("render", 0.2), ("planner", 0.2), ("blueprint", 0.02), ("crops", 0.03), ("worker", 0.4), ("merge", 0.02), ("emit", 0.03), ("audit", 0.1))


def share(done: Column, total: Column) -> Column:
    """Within 0 and 1; 0 of nothing."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), done / F.nullif(total, F.lit(0)))), F.lit(0.0))


def run_progress(status: Column, step: Column, rendered: Column, pages: Column, chunks_done: Column, chunks: Column) -> Column:
    """Finished steps and the part of the present one, where it is known."""
    total = sum(w for _, w in STEPS)
    before, out = 0.0, F.lit(0.0)
    for name, w in STEPS:
        part = share(rendered, pages) if name == "render" else share(chunks_done, chunks) if name == "worker" else F.lit(0.0)
        out = F.when(step == name, (F.lit(before) + F.lit(w) * part) / F.lit(total)).otherwise(out)
        before += w
    return F.when(status == "done", 1.0).otherwise(F.least(F.lit(1.0), out))


def batch_progress(runs: DataFrame) -> DataFrame:
    """A job's progress, its runs weighed by their pages (one at least)."""
    w = F.greatest(F.lit(1), F.coalesce("page_count", F.lit(1)))
    return runs.groupBy("job_id").agg((F.sum(F.col("progress") * w) / F.sum(w)).alias("progress"))


def utc_day(t: Column) -> Column:
    """the UTC day of an instant, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(t) / F.lit(86_400_000_000)).cast("int"))


def daily_quota(log: DataFrame, limit: int = 500) -> DataFrame:
    """Requests per UTC day and model, and what is left of the allowance."""
    n = F.count("*")
    return log.groupBy(utc_day(F.col("t")).alias("day"), "model").agg(n.alias("requests"), F.greatest(F.lit(0), F.lit(limit) - n).alias("left"))


def stage_totals(log: DataFrame) -> DataFrame:
    """A12."""
    return log.groupBy("event").agg(F.sum("ms").alias("total_ms"), F.count("*").alias("n"))


def run_timings(log: DataFrame) -> DataFrame:
    """Per run, the time logged, and between its first and last event."""
    elapsed = (F.unix_micros(F.max("t")) - F.unix_micros(F.min("t"))) / 60_000_000
    return log.groupBy("run_id").agg(F.sum("ms").alias("total_ms"), F.count("*").alias("n"), elapsed.alias("minutes"))


def log_groups(log: DataFrame) -> DataFrame:
    """Runs in the order of their first event, with the number of problems."""
    return log.groupBy("run_id").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"), F.count_if(F.col("level") != "info").alias("problems"))


def rate_window(log: DataFrame, seconds: int, *key: str) -> DataFrame:
    """Events of the last ``seconds`` at each event, and the gap before it, per ``key``."""
    by = Window.partitionBy(*key)
    at = F.unix_micros("t")
    inside = by.orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return log.withColumn("recent", F.count("*").over(inside)).withColumn("gap_s", (at - F.lag(at).over(by.orderBy("t", "seq"))) / 1_000_000)


def failure_streaks(log: DataFrame, strikes: int = 3) -> DataFrame:
    """Consecutive failures per run up to each one; ``strikes`` of them demote."""
    order = Window.partitionBy("run_id").orderBy("t", "seq")
    island = F.sum((F.col("event") != "error").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    inside = Window.partitionBy("run_id", "island").orderBy("t", "seq")
    out = log.withColumn("island", island).withColumn("streak", F.sum((F.col("event") == "error").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return out.filter("event = 'error'").select("run_id", "seq", "streak", (F.col("streak") >= strikes).alias("demoted"))


def newest(log: DataFrame, keep: int = 500, *key: str) -> DataFrame:
    """The newest entries, per ``key``."""
    return log.withColumn("age", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("seq")))).filter(F.col("age") <= keep)


def token_rollup(usage: DataFrame) -> DataFrame:
    """Per run, tokens of its messages (each once, as last reported), their time span, and the commonest model (the greater of equals)."""
    one = usage.groupBy("run_id", "message").agg(F.max_by(F.struct("tokens", "model"), "seq").alias("last"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    totals = one.groupBy("run_id").agg(F.count("*").alias("messages"), F.sum("last.tokens").alias("tokens"), F.min("t0").alias("first_t"), F.max("t1").alias("last_t"))
    models = one.groupBy("run_id", F.col("last.model").alias("model")).agg(F.count("*").alias("n")).groupBy("run_id").agg(F.max_by("model", F.struct("n", "model")).alias("model"))
    return totals.join(models, "run_id")


def narrowed(settings: Column, field: str, low: int, high: int, default: int) -> Column:
    """A field of a JSON object, if it is a whole number in its range, else the default; malformed JSON gives the default."""
    v = F.try_variant_get(F.try_parse_json(settings), f"$.{field}", "double")
    return F.when((v == F.floor(v)) & v.between(low, high), v.cast("int")).otherwise(default)
