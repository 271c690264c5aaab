"""Retries of jobs that come due by themselves: a job that waits for one starts when its time has come, event or not."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import transitions as T

#: Fixed value: the progress of a job that has started.
BEGUN = 0.01
WAITS, STARTS = "retry-scheduled", "preparing"
COLUMNS = f"job_id long, {T.STATE}, fired long, last_fired_ms long"
_ROW = Row(*[c.split()[0] for c in COLUMNS.split(", ")])


def _started(s: Column, now: Column) -> Column:
    """The state s (job, fired, last_fired_ms) at the time now: a retry that is due by then starts the next attempt."""
    job = s["job"]
    due = (job["status"] == WAITS) & (job["next_retry_ms"] <= now)
    begun = F.struct(F.lit(STARTS).alias("status"), (job["attempt"] + 1).alias("attempt"), F.greatest(F.lit(BEGUN), job["progress"]).alias("progress"), F.lit(None).cast("long").alias("next_retry_ms"), (job["changes"] + 1).alias("changes"))
    return F.when(due, F.struct(begun.alias("job"), (s["fired"] + 1).alias("fired"), job["next_retry_ms"].alias("last_fired_ms"))).otherwise(s)


def folded(events: DataFrame) -> DataFrame:
    """job_id, the state of each job (see transitions), how many of its retries came due (fired) and when the last one did.

    Before an event, a retry that is due by its time has started; after the last one of all jobs, those that are due by then have. A
    retry starts one attempt: the next comes only after another failure.
    """
    row = F.struct("ms", "seq", "kind", "progress", "retryable", "attempt", "reset")
    rows = events.groupBy("job_id").agg(F.array_sort(F.collect_list(row)).alias("events"))
    last = events.agg(F.max("ms")).first()[0]
    start = F.struct(F.expr(T._START).alias("job"), F.lit(0).cast("long").alias("fired"), F.lit(None).cast("long").alias("last_fired_ms"))

    def step(s: Column, e: Column) -> Column:
        now = _started(s, e["ms"])
        return F.struct(T._moved(now["job"], e).alias("job"), now["fired"].alias("fired"), now["last_fired_ms"].alias("last_fired_ms"))

    ends = F.aggregate("events", start, step, lambda s: _started(s, F.lit(last).cast("long")))
    return rows.select("job_id", ends.alias("s")).select("job_id", "s.job.*", "s.fired", "s.last_fired_ms").where("status IS NOT NULL")


class Retries(StatefulProcessor):
    """A job's state, the times at which its retries have come due, and a timer for the next one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", T.STATE)
        self.fired = handle.getListState("fired", "ms long")

    def _now(self) -> tuple:
        return tuple(self.job.get()) if self.job.exists() else (None, 0, 0.0, None, 0)

    def _started(self, now: tuple, ms: int) -> tuple:
        status, attempt, progress, retry, changes = now
        if status != WAITS or retry > ms:
            return now
        self.fired.appendValue((retry,))
        return (STARTS, attempt + 1, max(BEGUN, progress), None, changes + 1)

    def _kept(self, key: tuple, now: tuple) -> Iterator[Row]:
        self.job.update(now)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now[0] == WAITS:
            self.handle.registerTimer(int(now[3]))
        times = [ms for (ms,) in self.fired.get()]
        yield _ROW(key[0], *now, len(times), max(times, default=None))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = self._now()
        for e in sorted(rows, key=lambda e: (e.ms, e.seq)):
            now = T._after(self._started(now, e.ms), e)
        return self._kept(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._kept(key, self._started(self._now(), expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


def streamed(events: DataFrame) -> DataFrame:
    """The states of the jobs that events or due retries have changed. Time is that of the events: a retry is due when an event of any
    job has come that is as late, and rows that come after that with an earlier time are too late."""
    timed = events.withColumn("at", F.timestamp_millis("ms")).withWatermark("at", "0 seconds")
    return timed.groupBy("job_id").transformWithState(Retries(), COLUMNS, "Update", "eventTime")
