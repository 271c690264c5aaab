"""Queries over streams of a queue's events: retries that come due, notices of changes with what is known of them."""

from __future__ import annotations

from ..operators import retries
from ..sources.tables import derived, issue_options, sql_of
from ..streaming import upserts
from .ranking import _stream
from .telemetry import ORACLES as _TELEMETRY


def job_retries(spark, sf):
    """Each job after its events and the retries that came due between them."""
    return retries.folded(derived(spark, sf, "job_events"))


def stream_job_retries(spark, sf):
    """The same from a stream, with timers."""
    return upserts.job_retries(_stream(spark, sf, "job_events"))


def stream_issue_notices(spark, sf):
    """The notices of a stream of clicks: each with the titles and sums as they are when it is told."""
    return upserts.issue_notices(_stream(spark, sf, "issue_clicks"), issue_options(spark))


QUERIES = {f.__name__: f for f in (job_retries, stream_job_retries, stream_issue_notices)}

_TRIES = "greatest(1, s.attempt, e.attempt)"
_OPEN = "s.status NOT IN ('completed', 'failed', 'cancelled')"
#: Before each event and at the end stands a tick, at which a retry that is due by then starts.
_RETRIES = f"""WITH RECURSIVE {sql_of("job_events")},
every AS (SELECT job_id, ms, seq, 1 AS part, kind, progress, retryable, attempt, reset FROM job_events
  UNION ALL SELECT job_id, ms, seq, 0, 'tick', 0, FALSE, 0, FALSE FROM job_events
  UNION ALL SELECT job_id, (SELECT max(ms) FROM job_events), 9223372036854775807, 0, 'tick', 0, FALSE, 0, FALSE FROM job_events GROUP BY job_id),
e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ms, seq, part) AS n FROM every),
s(job_id, n, status, attempt, progress, next_retry_ms, changes, fired, last_fired_ms) AS (
  SELECT DISTINCT job_id, CAST(0 AS bigint), CAST(NULL AS varchar), CAST(0 AS bigint), CAST(0 AS double), CAST(NULL AS bigint), CAST(0 AS bigint), CAST(0 AS bigint), CAST(NULL AS bigint) FROM e
  UNION ALL SELECT s.job_id, e.n,
    CASE m WHEN 'added' THEN 'queued' WHEN 'retry' THEN 'queued' WHEN 'progress' THEN 'processing' WHEN 'again' THEN 'retry-scheduled' WHEN 'start' THEN 'preparing' WHEN 'removed' THEN NULL ELSE coalesce(m, s.status) END,
    CASE WHEN m IN ('added', 'removed') OR m = 'retry' AND e.reset THEN 0 WHEN m IN ('again', 'failed') THEN {_TRIES} WHEN m = 'start' THEN s.attempt + 1 ELSE s.attempt END,
    CASE WHEN m IN ('added', 'removed', 'retry') THEN 0.0 WHEN m = 'progress' THEN least(1.0, greatest(s.progress, e.progress)) WHEN m = 'completed' THEN 1.0 WHEN m = 'start' THEN greatest(0.01, s.progress) ELSE s.progress END,
    CASE WHEN m = 'again' THEN e.ms + CASE {_TRIES} WHEN 1 THEN 1500 ELSE 3000 END WHEN m IS NULL OR m IN ('progress', 'interrupted') THEN s.next_retry_ms END,
    s.changes + CASE WHEN m IS NULL THEN 0 ELSE 1 END, s.fired + CASE WHEN m = 'start' THEN 1 ELSE 0 END, CASE WHEN m = 'start' THEN s.next_retry_ms ELSE s.last_fired_ms END
  FROM s JOIN e ON e.job_id = s.job_id AND e.n = s.n + 1, LATERAL (SELECT CASE
    WHEN e.kind = 'tick' THEN CASE WHEN s.status = 'retry-scheduled' AND s.next_retry_ms <= e.ms THEN 'start' END
    WHEN s.status IS NULL THEN CASE WHEN e.kind = 'added' THEN 'added' END
    WHEN e.kind = 'progress' AND {_OPEN} THEN 'progress' WHEN e.kind = 'completed' AND s.status <> 'completed' THEN 'completed'
    WHEN e.kind = 'failed' AND s.status NOT IN ('completed', 'cancelled') THEN CASE WHEN e.retryable AND {_TRIES} < 3 THEN 'again' ELSE 'failed' END
    WHEN e.kind = 'retry' AND (s.status IN ('interrupted', 'retry-scheduled') OR s.status = 'failed' AND e.reset) THEN 'retry'
    WHEN e.kind = 'cancelled' AND {_OPEN} THEN 'cancelled' WHEN e.kind = 'interrupted' AND s.status IN ('preparing', 'processing', 'finalizing') THEN 'interrupted' WHEN e.kind = 'removed' THEN 'removed' END AS m))
SELECT job_id, status, attempt, progress, next_retry_ms, changes, fired, last_fired_ms FROM s QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n DESC) = 1 AND status IS NOT NULL"""

#: A table that is one file is one batch, whose notices are those of the batch form.
ORACLES = {"job_retries": _RETRIES, "stream_job_retries": _RETRIES, "stream_issue_notices": _TELEMETRY["issue_notices"]}
