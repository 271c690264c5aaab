"""Streams: retries that come due with and without later events, in several batches and after a restart."""

import random

import pytest

from quillon.operators import issues, retries
from quillon.sources.tables import ISSUES, issue_options
from quillon.streaming import upserts

EVENTS = "job_id long, seq long, ms long, kind string, progress double, retryable boolean, attempt long, reset boolean"


def events(n, seed):
    rng = random.Random(seed)
    kinds = ["added"] * 3 + ["progress", "failed", "failed", "completed", "retry", "cancelled", "interrupted", "removed"]
    return [(rng.randrange(12), i, 1_000_000 + i * 400 + rng.randrange(300), rng.choice(kinds), rng.random(), rng.random() < 0.8, rng.randrange(3), rng.random() < 0.5) for i in range(n)]


def states(df):
    return sorted(tuple(r) for r in df.collect())


def write(spark, rows, path):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)


def test_a_retry_fires_without_an_event_of_its_job(spark, tmp_path):
    rows = [(1, 0, 1000, "added", 0.0, True, 0, False), (1, 1, 2000, "failed", 0.0, True, 1, False), (2, 2, 3400, "added", 0.0, True, 0, False), (2, 3, 9000, "progress", 0.5, True, 0, False)]
    due = [(1, "preparing", 2, 0.01, None, 3, 1, 3500), (2, "processing", 0, 0.5, None, 2, 0, None)]
    assert states(retries.folded(spark.createDataFrame(rows, EVENTS))) == due
    early = states(retries.folded(spark.createDataFrame(rows[:3], EVENTS)))
    assert early[0] == (1, "retry-scheduled", 1, 0.0, 3500, 2, 0, None), "not yet"
    for i, row in enumerate(rows):
        write(spark, [row], str(tmp_path / "in"))
        got = states(upserts.job_retries(stream(spark, str(tmp_path / "in")), str(tmp_path / "out")))
        assert got == states(retries.folded(spark.createDataFrame(rows[: i + 1], EVENTS))), f"after {i + 1} events, each after a restart"
    assert got == due


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_equal_the_fold(spark, tmp_path, seed):
    rows = events(300, seed)
    for i in range(0, 300, 75):
        write(spark, rows[i : i + 75], str(tmp_path / "in"))
    got = states(upserts.job_retries(stream(spark, str(tmp_path / "in")), str(tmp_path / "out")))
    want = states(retries.folded(spark.createDataFrame(rows, EVENTS)))
    assert got == want and sum(r[6] for r in want) >= 3


CLICKS = "click_id long, user_id long, issue_key string, platform string, app_version string, ms long"


def test_notices_are_told_with_the_sums_of_their_time(spark, tmp_path):
    """Each batch's notices are those of all clicks so far, by the batch form."""
    rng = random.Random(4)
    clicks = [(i, rng.randrange(5), rng.choice([k for k, _, _ in ISSUES[:3]]), "ios", "1.0", 1000 * i) for i in range(60)]
    want = []
    for i in range(0, 60, 20):
        spark.createDataFrame(clicks[i : i + 20], CLICKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        so_far = spark.createDataFrame(clicks[: i + 20], CLICKS)
        rows = issues.accepted_changes(issues.changes(so_far))
        told = issues.notices(rows, issues.statistics(issues.fold_clicks(so_far), issue_options(spark)))
        want += [tuple(r) for r in told.where(f"click_id >= {i}").collect()]
        source = spark.readStream.schema(CLICKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = upserts.issue_notices(source, issue_options(spark), str(tmp_path / "out"))
        assert sorted(map(tuple, got.collect())) == sorted(want), f"after {i + 20} clicks, each time after a restart"


def test_a_job_is_kept_as_rows():
    """The processor takes and gives rows, in the order of time: no table is made for each job."""
    from pyspark.sql import Row

    class Value:
        now, times = None, ()
        exists = lambda self: self.now is not None
        get = lambda self: self.now if self.now is not None else iter(self.times)
        update = lambda self, now: setattr(self, "now", now)

    class Handle:
        getValueState = getListState = lambda self, *a: Value()
        listTimers = lambda self: iter(())
        registerTimer = deleteTimer = lambda self, ms: None

    job = retries.Retries()
    job.init(Handle())
    e = Row("job_id", "seq", "ms", "kind", "progress", "retryable", "attempt", "reset")
    rows = iter([e(1, 1, 2000, "failed", 0.0, True, 1, False), e(1, 0, 1000, "added", 0.0, True, 0, False)])
    assert [tuple(r) for r in job.handleInputRows((1,), rows, None)] == [(1, "retry-scheduled", 1, 0.0, 3500, 2, 0, None)]
