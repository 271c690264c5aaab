"""Jobs as the queue moves them from state to state, in batches and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .queue import ACTIVE, BASE_DELAY, GROWTH, MOST_DELAY, PENDING, TERMINAL, retry_delay

#: Fixed value: attempts of a job before it has failed for good.
ATTEMPTS = 3
STATE = "status string, attempt long, progress double, next_retry_ms long, changes long"
_START = "named_struct('status', CAST(NULL AS string), 'attempt', 0L, 'progress', 0.0D, 'next_retry_ms', CAST(NULL AS bigint), 'changes', 0L)"


def _moved(s: Column, e: Column) -> Column:
    """The state s after the event e (kind, ms, progress, retryable, attempt, reset). What isn't allowed changes nothing."""
    status, kind = s["status"], e["kind"]
    there, done = status.isNotNull(), status.isin(*TERMINAL)

    def to(name: Column | str, attempt: Column, progress: Column, retry: Column) -> Column:
        name = F.lit(name) if isinstance(name, str) else name
        return F.struct(name.cast("string").alias("status"), attempt.cast("long").alias("attempt"), progress.cast("double").alias("progress"), retry.cast("long").alias("next_retry_ms"), (s["changes"] + 1).alias("changes"))

    none = F.lit(None)
    tries = F.greatest(F.lit(1), s["attempt"], e["attempt"])
    again = e["retryable"] & (tries < ATTEMPTS)
    return (
        F.when((kind == "added") & ~there, to("queued", F.lit(0), F.lit(0.0), none))
        .when((kind == "progress") & there & ~done, to("processing", s["attempt"], F.least(F.lit(1.0), F.greatest(s["progress"], e["progress"])), s["next_retry_ms"]))
        .when((kind == "completed") & there & (status != "completed"), to("completed", s["attempt"], F.lit(1.0), none))
        .when((kind == "failed") & there & ~status.isin("completed", "cancelled"), to(F.when(again, "retry-scheduled").otherwise("failed"), tries, s["progress"], F.when(again, e["ms"] + retry_delay(tries))))
        .when((kind == "retry") & (status.isin("interrupted", "retry-scheduled") | ((status == "failed") & e["reset"])), to("queued", F.when(e["reset"], 0).otherwise(s["attempt"]), F.lit(0.0), none))
        .when((kind == "cancelled") & there & ~done, to("cancelled", s["attempt"], s["progress"], none))
        .when((kind == "interrupted") & status.isin(*ACTIVE), to("interrupted", s["attempt"], s["progress"], s["next_retry_ms"]))
        .when((kind == "removed") & there, to(none, F.lit(0), F.lit(0.0), none))
        .otherwise(s)
    )


def folded(events: DataFrame) -> DataFrame:
    """job_id and its state after all its events in order; jobs that aren't there (any more) have no row.

    A job's events are few, so they are one array: what comes next depends on all before, and jobs don't depend on one another.
    """
    row = F.struct("ms", "seq", "kind", "progress", "retryable", "attempt", "reset")
    rows = events.groupBy("job_id").agg(F.array_sort(F.collect_list(row)).alias("events"))
    rows = rows.select("job_id", F.aggregate("events", F.expr(_START), _moved).alias("s"))
    return rows.select("job_id", "s.*").where("status IS NOT NULL")


def _after(s: tuple, e) -> tuple:
    """The same as _moved for one event, for the state of a stream."""
    status, attempt, progress, retry, changes = s
    there, done, n = status is not None, status in TERMINAL, changes + 1
    if e.kind == "added" and not there:
        return ("queued", 0, 0.0, None, n)
    if not there:
        return s
    if e.kind == "progress" and not done:
        return ("processing", attempt, min(1.0, max(progress, e.progress)), retry, n)
    if e.kind == "completed" and status != "completed":
        return ("completed", attempt, 1.0, None, n)
    if e.kind == "failed" and status not in ("completed", "cancelled"):
        tries = max(1, attempt, e.attempt)
        if e.retryable and tries < ATTEMPTS:
            return ("retry-scheduled", tries, progress, e.ms + min(MOST_DELAY, BASE_DELAY * GROWTH ** (tries - 1)), n)
        return ("failed", tries, progress, None, n)
    if e.kind == "retry" and (status in ("interrupted", "retry-scheduled") or (status == "failed" and e.reset)):
        return ("queued", 0 if e.reset else attempt, 0.0, None, n)
    if e.kind == "cancelled" and not done:
        return ("cancelled", attempt, progress, None, n)
    if e.kind == "interrupted" and status in ACTIVE:
        return ("interrupted", attempt, progress, retry, n)
    if e.kind == "removed":
        return (None, 0, 0.0, None, n)
    return s


def _keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = state.get if state.exists else (None, 0, 0.0, None, 0)
    events = pd.concat(batches).sort_values(["ms", "seq"])
    for e in events.itertuples():
        now = _after(now, e)
    state.update(now)
    yield pd.DataFrame([(key[0], *now)], columns=["job_id", "status", "attempt", "progress", "next_retry_ms", "changes"]).astype({"next_retry_ms": "Int64"})


def streamed(events: DataFrame) -> DataFrame:
    """The states of the jobs that a batch of a stream of events has changed; batches come in the order of time."""
    return events.groupBy("job_id").applyInPandasWithState(_keep, f"job_id long, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def recovered(jobs: DataFrame) -> DataFrame:
    """Jobs after a restart: those at work are interrupted, and new_position is their place in their batch."""
    order = W.partitionBy("batch_id").orderBy(F.desc("priority"), "queue_position", "created_ms", "job_id")
    rows = jobs.withColumn("status", F.when(F.col("status").isin(*ACTIVE), F.lit("interrupted")).otherwise(F.col("status")))
    return rows.withColumn("new_position", (F.row_number().over(order) - 1).cast("long"))


def queue_states(jobs: DataFrame, least: int) -> DataFrame:
    """Of each batch whether all its jobs have ended (completed), what it is after a restart (stopped while jobs wait), and
    whether its end is announced: all completed and `least` jobs at least."""
    s = F.col("status")
    rows = jobs.groupBy("batch_id").agg(F.bool_and(s.isin(*TERMINAL)).alias("ended"), F.bool_or(s.isin(*PENDING, *ACTIVE)).alias("waits"), (F.bool_and(s == "completed") & (F.count("*") >= least)).alias("announced"))
    return rows.select("batch_id", "ended", F.when(F.col("waits"), "stopped").otherwise("completed").alias("after_restart"), "announced")
