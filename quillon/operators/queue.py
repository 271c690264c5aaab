"""The processing queue: statistics, order, retries, estimates and event history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.num import clamp, duration, estimate, half_up, percent
from ..sources.tables import STATUSES

ACTIVE, PENDING, TERMINAL = ("preparing", "processing", "finalizing"), ("queued", "paused", "interrupted", "retry-scheduled"), ("completed", "failed", "cancelled")
#: Time of an item before any is done, its bounds, weight of the newest duration, durations kept (ms).
INITIAL_MS, LEAST_MS, MOST_MS, NEWEST, KEPT = 100_000, 10_000, 600_000, 0.35, 20
#: Attempts, first delay, growth and longest delay of retries (ms).
MOST_ATTEMPTS, BASE_DELAY, GROWTH, MOST_DELAY = 10, 1500, 2, 30_000


def statistics(jobs: DataFrame, by: list[str] | None = None, fallback_ms: int = INITIAL_MS) -> DataFrame:
    """One row for all jobs, or for each group: jobs by status, sums of statuses, mean progress, mean time of completed jobs
    and the time that the rest would take. One aggregation in a single pass."""
    progress = clamp(F.col("progress"), 0.0, 1.0)
    done = (F.col("status") == "completed") & (F.col("total_processing_ms") > 0)
    counts = [F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in STATUSES]
    sums = [F.count_if(F.col("status").isin(*names)).alias(name) for name, names in (("active", ACTIVE), ("pending", PENDING), ("terminal", TERMINAL))]
    # progress comes in hundredths; whole numbers keep the sums free of the order of addition
    hundredths = F.sum(half_up(progress * 100))
    rows = jobs.groupBy(*by or []).agg(F.count("*").alias("total"), *counts, *sums, hundredths.alias("p"), F.avg(F.when(done, F.col("total_processing_ms"))).alias("mean"))
    p, total = F.coalesce("p", F.lit(0)), F.col("total")
    overall = F.when(total > 0, p / 100 / total).otherwise(F.lit(0.0))
    average = half_up(F.col("mean"))
    rest = half_up((total - p / 100) * F.coalesce(average, F.lit(fallback_ms)))
    return rows.select(
        *by or [], "total", *[s.replace("-", "_") for s in STATUSES], "active", "pending", "terminal",
        F.round(overall, 6).alias("overall_progress"), percent(overall).alias("overall_percentage"), average.cast("long").alias("average_completed_item_ms"),
        F.when(total == F.col("terminal"), F.lit(0)).otherwise(F.greatest(F.lit(0), rest)).cast("long").alias("estimated_remaining_ms"),
    )


def summary(stats: DataFrame, keys: list[str]) -> DataFrame:
    return stats.select(
        *keys, F.col("total").alias("total_items"), F.col("completed").alias("completed_items"), F.col("failed").alias("failed_items"), (F.col("pending") + F.col("active")).alias("pending_items"),
        "overall_percentage", "estimated_remaining_ms", (F.col("active") > 0).alias("is_active"), ((F.col("total") > 0) & (F.col("terminal") == F.col("total"))).alias("is_complete"), (F.col("failed") > 0).alias("has_failures"),
    )


def _order():
    return [F.desc("priority"), F.asc("queue_position"), F.asc("created_ms"), F.asc("job_id")]


def reindexed(jobs: DataFrame, by: str) -> DataFrame:
    """Jobs of each group with their place from 0: higher priority first, then position, then age."""
    return jobs.withColumn("new_position", (F.row_number().over(W.partitionBy(by).orderBy(*_order())) - 1).cast("long"))


def eligible(now_ms: int) -> Column:
    """Queued or interrupted, or waiting for a retry whose time has come or isn't set."""
    due = F.col("next_retry_ms").isNull() | (F.col("next_retry_ms") <= now_ms)
    return F.col("status").isin("queued", "interrupted") | ((F.col("status") == "retry-scheduled") & due)


def retry_delay(attempt: Column) -> Column:
    tries = F.least(F.lit(MOST_ATTEMPTS), F.greatest(F.lit(1), F.floor(attempt)))
    return duration(F.least(F.lit(float(MOST_DELAY)), F.lit(float(BASE_DELAY)) * F.pow(F.lit(float(GROWTH)), tries - 1)))


def with_retries(jobs: DataFrame) -> DataFrame:
    """next_retry_ms: when a job that waits for a retry is due, its age plus the delay of its attempt."""
    return jobs.withColumn("next_retry_ms", F.when(F.col("status") == "retry-scheduled", F.col("created_ms") + retry_delay(F.col("attempt"))))


def next_jobs(jobs: DataFrame, by: str, now_ms: int) -> DataFrame:
    """The first job of each group that may run now."""
    first = F.row_number().over(W.partitionBy(by).orderBy(*_order()))
    return jobs.where(eligible(now_ms)).withColumn("at", first).where("at = 1").drop("at")


def job_estimate(average_ms: int, now_ms: int) -> list[Column]:
    """estimated_total_ms, elapsed_ms and estimated_remaining_ms of a job (progress, status, created_ms, total_processing_ms)."""
    progress = clamp(F.col("progress"), 0.0, 1.0)
    elapsed = F.when(F.col("status").isin(*ACTIVE), F.least(F.lit(MOST_MS), F.lit(now_ms) - F.col("created_ms"))).otherwise(F.lit(0)).cast("long")
    bounded = lambda x: estimate(x, LEAST_MS, MOST_MS)
    by_progress = F.when((progress > 0.01) & (elapsed > 0), bounded(F.lit(average_ms * 0.45) + duration(elapsed / progress) * 0.55)).otherwise(F.lit(average_ms))
    stored = F.col("total_processing_ms")
    total = F.when(stored > 0, bounded(by_progress * 0.7 + stored * 0.3)).otherwise(by_progress)
    left = F.when(F.col("status").isin(*TERMINAL), F.lit(0)).when(F.col("status").isin(*ACTIVE), F.greatest(F.lit(0), total - elapsed)).otherwise(duration(total * F.greatest(F.lit(0.0), 1 - progress)))
    return [total.alias("estimated_total_ms"), elapsed.alias("elapsed_ms"), left.cast("long").alias("estimated_remaining_ms")]


def last_durations(rows: DataFrame, key: str, order: list[str], keep: int = KEPT) -> DataFrame:
    """The newest durations of each key and n, their place from the oldest kept."""
    newest = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= keep)


def smoothed(kept: DataFrame, key: str, mode: str = "incremental") -> DataFrame:
    """key, samples, smoothed_ms: durations from old to new, each the share NEWEST of the estimate, whole and bounded each time.

    incremental starts from the first duration, recalculated from INITIAL_MS and takes the first one in as well. A key has
    KEPT durations at most.
    """
    bounded = lambda x: estimate(x, LEAST_MS, MOST_MS)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("age")).alias("at"), "duration_ms"))), lambda x: x["duration_ms"])
    rows = kept.groupBy(key).agg(in_order.alias("d"))
    start = bounded(F.col("d")[0]) if mode == "incremental" else F.lit(INITIAL_MS).cast("long")
    rest = F.slice("d", 2, KEPT) if mode == "incremental" else F.col("d")
    folded = F.aggregate(rest, start, lambda e, d: bounded(d * F.lit(NEWEST) + e * F.lit(1 - NEWEST)))
    return rows.select(key, F.size("d").cast("long").alias("samples"), folded.alias("smoothed_ms"))


def duration_summary(kept: DataFrame, key: str) -> DataFrame:
    weight = clamp(F.col("weight"), 0.01, 100.0)
    return kept.groupBy(key).agg(
        F.floor(F.round(F.sum(F.col("duration_ms") * weight) / F.sum(weight), 6)).cast("long").alias("weighted_ms"),
        F.floor(F.avg("duration_ms")).cast("long").alias("mean_ms"),
        F.min("duration_ms").alias("least_ms"),
        F.max("duration_ms").alias("most_ms"),
    )


def batches(jobs: DataFrame) -> DataFrame:
    """Each batch: its items, those completed, failed, at work and (the rest) queued, and the percentage that has ended."""
    s = F.col("status")
    rows = jobs.groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if(s == "completed").alias("completed"), F.count_if(s.isin("failed", "cancelled")).alias("failed"), F.count_if(s.isin(*ACTIVE)).alias("processing"))
    ended = F.col("completed") + F.col("failed")
    queued = F.greatest(F.lit(0), F.col("total") - ended - F.col("processing"))
    return rows.select("*", queued.cast("long").alias("queued"), half_up(ended * 100 / F.col("total")).cast("int").alias("progress"))


def enqueued(requests: DataFrame, key: list[str], capacity: int, by: str) -> DataFrame:
    """job_id, by and decision of each request: full, duplicate or accepted.

    Requests come in order of created_ms and job_id. Room is looked at before repeats: of what comes after the first
    `capacity` accepted ones all is full. Accepted are the first ones of each key.
    """
    order = W.partitionBy(by).orderBy("created_ms", "job_id")
    fresh = F.row_number().over(W.partitionBy(by, *key).orderBy("created_ms", "job_id")) == 1
    rows = requests.withColumn("fresh", fresh)
    before = F.coalesce(F.sum(F.col("fresh").cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    decision = F.when(before >= capacity, F.lit("full")).when(~F.col("fresh"), F.lit("duplicate")).otherwise(F.lit("accepted"))
    return rows.withColumn("decision", decision).drop("fresh")


def last_events(events: DataFrame, limit: int, by: str | None = None) -> DataFrame:
    """The newest events by seq, of all or of each key; without a key one top-k, with one a limit before the shuffle."""
    if by is None:
        return events.orderBy(F.desc("seq")).limit(limit)
    newest = F.row_number().over(W.partitionBy(by).orderBy(F.desc("seq")))
    return events.where(F.col(by).isNotNull()).withColumn("at", newest).where(F.col("at") <= limit).drop("at")


def subscribed(events: DataFrame, types: list[str] | None = None, batch_id: int | None = None, job_ids: list[int] | None = None, without_job: bool = False) -> DataFrame:
    """The events that a subscription gets; one for jobs gets events without a job only if it says so."""
    if types:
        events = events.where(F.col("type").isin(*types))
    if batch_id is not None:
        events = events.where(F.col("batch_id") == batch_id)
    if job_ids:
        events = events.where(F.coalesce(F.col("job_id").isin(*job_ids), F.lit(without_job)))
    return events
