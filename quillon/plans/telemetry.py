"""Queries over issue reports and the processing queue."""

from __future__ import annotations

from ..operators import issues, queue
from ..sources.tables import ISSUES, SQL_OPTIONS, STATUSES, derived, issue_options, sql_of

NOW_MS = 915_148_800_000


def _reports(spark, sf):
    return issues.fold_clicks(derived(spark, sf, "issue_clicks"))


def issue_counting_upsert(spark, sf):
    return _reports(spark, sf)


def issue_statistics(spark, sf):
    return issues.statistics(_reports(spark, sf), issue_options(spark)).orderBy("display_order")


def issue_details(spark, sf):
    return issues.details(_reports(spark, sf), issue_options(spark))


def issue_details_of_key(spark, sf):
    return issues.details(_reports(spark, sf), issue_options(spark), f" {ISSUES[2][0]} ")


def issue_totals_for_key(spark, sf):
    return issues.totals(_reports(spark, sf), ISSUES[0][0])


def issue_constraint_violations(spark, sf):
    return issues.violations(_reports(spark, sf), issue_options(spark))


def issue_cdc_filter(spark, sf):
    return issues.accepted_changes(issues.changes(derived(spark, sf, "issue_clicks")))


def issue_notices(spark, sf):
    rows = issues.accepted_changes(issues.changes(derived(spark, sf, "issue_clicks")))
    return issues.notices(rows, issues.statistics(_reports(spark, sf), issue_options(spark)))


def issue_rpc_json(spark, sf):
    return issues.response_json(_reports(spark, sf), issue_options(spark))


def _jobs(spark, sf):
    return queue.with_retries(derived(spark, sf, "jobs"))


def queue_statistics(spark, sf):
    return queue.statistics(_jobs(spark, sf))


def queue_statistics_by_batch(spark, sf):
    return queue.statistics(_jobs(spark, sf), ["batch_id"])


def queue_summary(spark, sf):
    return queue.summary(queue.statistics(_jobs(spark, sf), ["batch_id"]), ["batch_id"])


def queue_order(spark, sf):
    return queue.reindexed(_jobs(spark, sf), "batch_id").select("job_id", "batch_id", "new_position")


def next_job(spark, sf):
    return queue.next_jobs(_jobs(spark, sf), "batch_id", NOW_MS).select("batch_id", "job_id", "priority", "status")


def next_retry(spark, sf):
    return _jobs(spark, sf).where("status = 'retry-scheduled'").groupBy("batch_id").agg({"next_retry_ms": "min"}).withColumnRenamed("min(next_retry_ms)", "next_retry_ms")


def retry_backoff(spark, sf):
    rows = derived(spark, sf, "jobs")
    return rows.select("job_id", "attempt", queue.retry_delay(rows["attempt"]).alias("delay_ms"))


def job_eta(spark, sf):
    return derived(spark, sf, "jobs").select("job_id", *queue.job_estimate(queue.INITIAL_MS, NOW_MS))


def batch_rollup(spark, sf):
    return queue.batches(derived(spark, sf, "jobs"))


def enqueue_dedupe_capacity(spark, sf):
    return queue.enqueued(derived(spark, sf, "jobs"), ["item_id"], 100, "batch_id").select("job_id", "batch_id", "decision")


_LAST = ["ship_ms", "order_key", "line_no", "part_key", "duration_ms"]


def _kept(spark, sf):
    return queue.last_durations(derived(spark, sf, "durations"), "supp_key", _LAST)


def duration_ema(spark, sf):
    return queue.smoothed(_kept(spark, sf), "supp_key")


def duration_ema_recalculated(spark, sf):
    return queue.smoothed(_kept(spark, sf), "supp_key", "recalculated")


def duration_bounds(spark, sf):
    return queue.duration_summary(_kept(spark, sf), "supp_key")


def event_history_last_n(spark, sf):
    return queue.last_events(derived(spark, sf, "queue_events"), 100)


def event_history_by_job(spark, sf):
    return queue.last_events(derived(spark, sf, "queue_events"), 5, "job_id")


def event_history_by_batch(spark, sf):
    return queue.last_events(derived(spark, sf, "queue_events"), 20, "batch_id")


def event_filter(spark, sf):
    return queue.subscribed(derived(spark, sf, "queue_events"), ["job-added", "queue-updated"], 3, [1, 2, 3, 5, 8, 13, 21, 34], True)


QUERIES = {f.__name__: f for f in (
    issue_counting_upsert, issue_statistics, issue_details, issue_details_of_key, issue_totals_for_key, issue_constraint_violations, issue_cdc_filter, issue_notices, issue_rpc_json,
    queue_statistics, queue_statistics_by_batch, queue_summary, queue_order, next_job, next_retry, retry_backoff, job_eta, batch_rollup, enqueue_dedupe_capacity,
    duration_ema, duration_ema_recalculated, duration_bounds, event_history_last_n, event_history_by_job, event_history_by_batch, event_filter,
)}

_REPORTS = "WITH " + sql_of("issue_clicks") + """, reports AS (SELECT user_id, issue_key, count(*) AS report_count, min(ms) AS first_reported_ms, max(ms) AS last_reported_ms,
  arg_max(platform, row(ms, click_id)) AS platform, arg_max(app_version, row(ms, click_id)) FILTER (WHERE app_version IS NOT NULL) AS app_version FROM issue_clicks GROUP BY 1, 2), """ + SQL_OPTIONS
_STATS = """stats AS (SELECT o.issue_key, o.title_en, o.display_order, o.is_active, count(r.user_id) AS unique_reporters, CAST(coalesce(sum(r.report_count), 0) AS bigint) AS total_reports, min(r.first_reported_ms) AS first_reported_ms,
  max(r.last_reported_ms) AS last_reported_ms, count(r.user_id) FILTER (WHERE r.platform = 'ios') AS ios_unique_reporters, count(r.user_id) FILTER (WHERE r.platform = 'android') AS android_unique_reporters
  FROM options o LEFT JOIN reports r USING (issue_key) GROUP BY 1, 2, 3, 4)"""
_CHANGES = """changes AS (SELECT click_id, user_id, issue_key, row_number() OVER w AS n FROM issue_clicks WINDOW w AS (PARTITION BY user_id, issue_key ORDER BY ms, click_id)),
  accepted AS (SELECT click_id, user_id, issue_key, CASE WHEN n = 1 THEN 'INSERT' ELSE 'UPDATE' END AS op, n - 1 AS old_count, n AS new_count FROM changes)"""
_JOBS = "WITH " + sql_of("jobs") + ", j AS (SELECT *, CASE WHEN status = 'retry-scheduled' THEN created_ms + CAST(floor(least(30000.0, 1500.0 * 2.0 ** (least(10, greatest(1, attempt)) - 1))) AS bigint) END AS next_retry_ms FROM jobs)"
_COUNTS = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s.replace('-', '_')}" for s in STATUSES)


def _statistics(key: str = "") -> str:
    group = f"GROUP BY {key}" if key else ""
    key = key and key + ", "
    return f"""stats0 AS (SELECT {key}count(*) AS total, {_COUNTS}, sum(CAST(floor(progress * 100 + 0.5e0) AS bigint)) AS p, floor(avg(total_processing_ms) FILTER (WHERE status = 'completed' AND total_processing_ms > 0) + 0.5e0) AS a FROM j {group}),
  stats AS (SELECT {key}total, {', '.join(s.replace('-', '_') for s in STATUSES)}, preparing + processing + finalizing AS active, queued + paused + interrupted + retry_scheduled AS pending, completed + failed + cancelled AS terminal,
  round(CAST(p AS double) / 100 / total, 6) AS overall_progress, CAST(floor(CAST(p AS double) / 100 / total * 100 + 0.5e0) AS int) AS overall_percentage, CAST(a AS bigint) AS average_completed_item_ms,
  CASE WHEN total = completed + failed + cancelled THEN 0 ELSE CAST(greatest(0, floor((total - CAST(p AS double) / 100) * coalesce(a, 100000) + 0.5e0)) AS bigint) END AS estimated_remaining_ms FROM stats0)"""


_KEPT = "WITH " + sql_of("durations") + ", k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY supp_key ORDER BY ship_ms DESC, order_key DESC, line_no DESC, part_key DESC, duration_ms DESC) AS age FROM durations) WHERE age <= 20)"


def _ema(start: str, rest: str) -> str:
    step = "greatest(10000, least(600000, CAST(floor({d} * 0.35e0 + {e} * (1 - 0.35e0)) AS bigint)))"
    return _KEPT + f""", d AS (SELECT supp_key, list(duration_ms ORDER BY age DESC) AS d FROM k GROUP BY 1)
  SELECT supp_key, len(d) AS samples, list_reduce(list_prepend({start}, {rest}), lambda e, x: {step.format(d='x', e='e')}) AS smoothed_ms FROM d"""


_E = "WITH " + sql_of("queue_events")
_ETA = "WITH " + sql_of("jobs") + """, a AS (SELECT *, CASE WHEN status IN ('preparing', 'processing', 'finalizing') THEN least(600000, 915148800000 - created_ms) ELSE 0 END AS elapsed_ms FROM jobs),
  b AS (SELECT *, CASE WHEN progress > 0.01 AND elapsed_ms > 0 THEN least(600000, greatest(10000, CAST(floor(45000.0e0 + floor(elapsed_ms / progress) * 0.55e0) AS bigint))) ELSE 100000 END AS t FROM a),
  c AS (SELECT *, CASE WHEN total_processing_ms > 0 THEN least(600000, greatest(10000, CAST(floor(t * 0.7e0 + total_processing_ms * 0.3e0) AS bigint))) ELSE t END AS estimated_total_ms FROM b)
  SELECT job_id, estimated_total_ms, elapsed_ms, CASE WHEN status IN ('completed', 'failed', 'cancelled') THEN 0 WHEN status IN ('preparing', 'processing', 'finalizing') THEN greatest(0, estimated_total_ms - elapsed_ms)
  ELSE CAST(floor(estimated_total_ms * greatest(0.0e0, 1 - progress)) AS bigint) END AS estimated_remaining_ms FROM c"""
_DETAILS = ", d AS (SELECT r.*, o.title_en AS issue_title FROM reports r JOIN options o USING (issue_key)) SELECT * FROM d"

ORACLES = {
    "issue_counting_upsert": _REPORTS + " SELECT * FROM reports",
    "issue_statistics": f"{_REPORTS}, {_STATS} SELECT * FROM stats ORDER BY display_order",
    "issue_details": _REPORTS + _DETAILS,
    "issue_details_of_key": _REPORTS + _DETAILS + " WHERE issue_key = 'background_removal_problem'",
    "issue_totals_for_key": _REPORTS + " SELECT count(*) AS unique_reporters, CAST(coalesce(sum(report_count), 0) AS bigint) AS total_reports FROM reports WHERE issue_key = 'scan_item_not_completed'",
    "issue_constraint_violations": _REPORTS + """, v AS (SELECT unnest([CASE WHEN issue_key NOT IN (SELECT issue_key FROM options) THEN 'issue_key_exists' END, CASE WHEN platform NOT IN ('ios', 'android', 'unknown') THEN 'platform_known' END,
      CASE WHEN report_count < 1 THEN 'count_positive' END, CASE WHEN length(app_version) > 100 THEN 'app_version_length' END, CASE WHEN report_count > 3 THEN 'repeated_reporter' END]) AS rule FROM reports)
      SELECT rule, count(*) AS n FROM v WHERE rule IS NOT NULL GROUP BY 1""",
    "issue_cdc_filter": f"{_REPORTS}, {_CHANGES} SELECT * FROM accepted",
    "issue_rpc_json": f"""{_REPORTS}, sums AS (SELECT issue_key, count(*) AS n, sum(report_count) AS total FROM reports GROUP BY 1)
      SELECT user_id, issue_key, CAST(json_object('success', TRUE, 'issue', json_object('issueKey', issue_key, 'title', title_en), 'report', json_object('issueKey', issue_key, 'reportCount', report_count, 'firstReportedAt', first_reported_ms, 'lastReportedAt', last_reported_ms),
        'statistics', json_object('uniqueReporters', n, 'totalReports', CAST(total AS bigint))) AS varchar) AS response FROM reports JOIN sums USING (issue_key) JOIN options USING (issue_key)""",
    "issue_notices": f"""{_REPORTS}, {_STATS}, {_CHANGES} SELECT click_id, user_id, issue_key, CASE WHEN op = 'INSERT' THEN 'New issue report' ELSE 'Repeated issue report' END AS heading,
      CASE WHEN length(title_en) > 40 THEN substr(title_en, 1, 39) || '…' ELSE title_en END || ': ' || total_reports || ' by ' || unique_reporters AS body FROM accepted JOIN stats USING (issue_key)""",
    "queue_statistics": f"{_JOBS}, {_statistics()} SELECT * FROM stats",
    "queue_statistics_by_batch": f"{_JOBS}, {_statistics('batch_id')} SELECT * FROM stats",
    "queue_summary": f"""{_JOBS}, {_statistics('batch_id')} SELECT batch_id, total AS total_items, completed AS completed_items, failed AS failed_items, pending + active AS pending_items, overall_percentage, estimated_remaining_ms,
      active > 0 AS is_active, total > 0 AND terminal = total AS is_complete, failed > 0 AS has_failures FROM stats""",
    "queue_order": _JOBS + " SELECT job_id, batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY priority DESC, queue_position, created_ms, job_id) - 1 AS new_position FROM j",
    "next_job": _JOBS + f""" SELECT batch_id, job_id, priority, status FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY priority DESC, queue_position, created_ms, job_id) AS place FROM j
      WHERE status IN ('queued', 'interrupted') OR (status = 'retry-scheduled' AND (next_retry_ms IS NULL OR next_retry_ms <= {NOW_MS}))) WHERE place = 1""",
    "next_retry": _JOBS + " SELECT batch_id, min(next_retry_ms) AS next_retry_ms FROM j WHERE status = 'retry-scheduled' GROUP BY 1",
    "retry_backoff": _JOBS + " SELECT job_id, attempt, CAST(floor(least(30000.0, 1500.0 * 2.0 ** (least(10, greatest(1, attempt)) - 1))) AS bigint) AS delay_ms FROM j",
    "job_eta": _ETA,
    "batch_rollup": _JOBS + """, b AS (SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status IN ('failed', 'cancelled')) AS failed,
      count(*) FILTER (WHERE status IN ('preparing', 'processing', 'finalizing')) AS processing FROM j GROUP BY 1)
      SELECT *, greatest(0, total - completed - failed - processing) AS queued, CAST(floor((completed + failed) * 100 / total + 0.5e0) AS int) AS progress FROM b""",
    "enqueue_dedupe_capacity": _JOBS + """, f AS (SELECT *, row_number() OVER (PARTITION BY batch_id, item_id ORDER BY created_ms, job_id) = 1 AS fresh FROM j),
      g AS (SELECT *, coalesce(sum(CAST(fresh AS int)) OVER (PARTITION BY batch_id ORDER BY created_ms, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
      SELECT job_id, batch_id, CASE WHEN before >= 100 THEN 'full' WHEN NOT fresh THEN 'duplicate' ELSE 'accepted' END AS decision FROM g""",
    "duration_ema": _ema("greatest(10000, least(600000, d[1]))", "d[2:]"),
    "duration_ema_recalculated": _ema("CAST(100000 AS bigint)", "d"),
    "duration_bounds": _KEPT + """ SELECT supp_key, CAST(floor(round(sum(duration_ms * weight) / sum(weight), 6)) AS bigint) AS weighted_ms, CAST(floor(avg(duration_ms)) AS bigint) AS mean_ms, min(duration_ms) AS least_ms, max(duration_ms) AS most_ms FROM k GROUP BY 1""",
    "event_history_last_n": _E + " SELECT * FROM queue_events ORDER BY seq DESC LIMIT 100",
    "event_history_by_job": _E + " SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS place FROM queue_events WHERE job_id IS NOT NULL) WHERE place <= 5",
    "event_history_by_batch": _E + " SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY seq DESC) AS place FROM queue_events) WHERE place <= 20",
    "event_filter": _E + " SELECT * FROM queue_events WHERE type IN ('job-added', 'queue-updated') AND batch_id = 3 AND (job_id IS NULL OR job_id IN (1, 2, 3, 5, 8, 13, 21, 34))",
}
