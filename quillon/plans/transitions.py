"""Queries over the states of jobs and over changes to keyed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.num import estimate
from ..operators import mutations as M
from ..operators import queue, transitions
from ..sources.tables import ISSUES, derived, given, issue_options, sql_of

#: Fixed value: completed items that a session has at least when its end is announced.
ANNOUNCED = 5
_SAMPLE = ["ship_ms", "order_key", "line_no", "part_key", "duration_ms"]


def job_transitions(spark, sf):
    return transitions.folded(derived(spark, sf, "job_events"))


def restart_recovery(spark, sf):
    return transitions.recovered(derived(spark, sf, "jobs")).select("job_id", "batch_id", "status", "new_position")


def queue_completion(spark, sf):
    return transitions.queue_states(derived(spark, sf, "jobs").withColumn("batch_id", F.col("item_id")), ANNOUNCED)


def job_predicates(spark, sf):
    """What may be done with a job: those that have ended, are at work or wait; retried by hand, and cancelled."""
    s = F.col("status")
    exhausted = F.col("attempt") >= transitions.ATTEMPTS
    return derived(spark, sf, "jobs").select(
        "job_id", s.isin(*queue.TERMINAL).alias("is_terminal"), s.isin(*queue.ACTIVE).alias("is_active"), s.isin(*queue.PENDING).alias("is_pending"),
        ((s == "failed") & ~exhausted).alias("can_retry"), (~s.isin(*queue.TERMINAL)).alias("can_cancel"),
    )


def latest_event(spark, sf):
    """The last event of each batch."""
    return derived(spark, sf, "queue_events").groupBy("batch_id").agg(F.max_by(F.struct("type", "job_id", "ms"), "seq").alias("e"), F.max("seq").alias("seq")).select("batch_id", "seq", "e.*")


def completed_once(spark, sf):
    """A duration for each job that completes, from its first completion only."""
    rows = derived(spark, sf, "job_events").where("kind = 'completed'")
    return rows.groupBy("job_id").agg(F.min_by("seq", F.struct("ms", "seq")).alias("seq"), F.min("ms").alias("completed_ms"))


def observed_jobs(spark, sf):
    """The jobs of the queue that events tell about."""
    seen = derived(spark, sf, "queue_events").select("job_id").where("job_id IS NOT NULL").distinct()
    return derived(spark, sf, "jobs").join(seen, "job_id", "left_semi").select("job_id", "status")


def samples_without_job(spark, sf):
    """The smoothed time of each supplier after the samples of some orders are deleted, worked out anew from the start."""
    kept = queue.last_durations(derived(spark, sf, "durations"), "supp_key", _SAMPLE)
    gone = given(spark, sf, "orders").where("o_orderkey % 3 = 0").selectExpr("o_orderkey AS order_key")
    left = M.deleted(kept, gone, ["order_key"])
    return queue.smoothed(left, "supp_key", "recalculated")


def average_item_time(spark, sf):
    """0.45 of the weighted mean and 0.55 of the smoothed time of each supplier, bounded."""
    kept = queue.last_durations(derived(spark, sf, "durations"), "supp_key", _SAMPLE)
    rows = queue.smoothed(kept, "supp_key").join(queue.duration_summary(kept, "supp_key"), "supp_key")
    return rows.select("supp_key", estimate(F.col("weighted_ms") * 0.45 + F.col("smoothed_ms") * 0.55, queue.LEAST_MS, queue.MOST_MS).alias("average_ms"))


def queue_eta(spark, sf):
    """Of each batch the jobs at work, waiting and ended, and the time left: of those at work first, then of the others."""
    jobs = derived(spark, sf, "jobs")
    e = queue.job_estimate(queue.INITIAL_MS, 915_148_800_000)
    s = F.col("status")
    rows = jobs.select("batch_id", "status", e[2])
    return rows.groupBy("batch_id").agg(
        F.count_if(s.isin(*queue.ACTIVE)).alias("active"), F.count_if(s.isin(*queue.PENDING)).alias("pending"), F.count_if(s.isin(*queue.TERMINAL)).alias("ended"),
        F.coalesce(F.sum(F.when(s.isin(*queue.ACTIVE), F.col("estimated_remaining_ms"))), F.lit(0)).alias("active_ms"), F.sum("estimated_remaining_ms").alias("remaining_ms"),
    )


def _items(spark, sf):
    return given(spark, sf, "customer").selectExpr("c_custkey AS id", "c_nationkey AS owner_id", "c_name AS name", "c_custkey % 2 = 0 AS favorite", "0L AS updated_ms", "'ready' AS state")


def _changes(spark, sf, change):
    return derived(spark, sf, "item_changes").where(F.col("change") == change)


def insert_items(spark, sf):
    """The table with the rows that are added: names without blanks around them, ready unless they say otherwise."""
    new = _changes(spark, sf, "insert").selectExpr("seq + 1000000 AS id", "id % 25 AS owner_id", "name", "favorite", "ms AS updated_ms", "CAST(NULL AS string) AS state")
    return M.inserted(_items(spark, sf), new, {"state": F.lit("ready"), "favorite": F.lit(False)})


def update_items(spark, sf):
    """The table after the last update of each item; what an update doesn't say stays, and its time is kept."""
    last = M.last_changes(_changes(spark, sf, "update").select("id", "ms", "seq", F.nullif(F.trim("name"), F.lit("")).alias("name"), "favorite"), ["id"], ["ms", "seq"])
    return M.updated(_items(spark, sf), last, ["id"], ["name", "favorite"], "updated_ms", "ms")


def delete_items(spark, sf):
    return M.deleted(_items(spark, sf), _changes(spark, sf, "delete"), ["id"]).select("id", "owner_id")


def delete_owned(spark, sf):
    """What is left when the owners of the nations of one region reset their wardrobes."""
    owners = given(spark, sf, "nation").where("n_regionkey = 2").selectExpr("n_nationkey AS owner_id")
    return M.deleted(_items(spark, sf), owners, ["owner_id"]).select("id", "owner_id")


def upsert_items(spark, sf):
    """Items put in by their id: the last one of each id, new or in place of what was there."""
    new = derived(spark, sf, "item_changes").selectExpr("id + 700 AS id", "id % 25 AS owner_id", "trim(coalesce(name, 'none')) AS name", "coalesce(favorite, FALSE) AS favorite", "ms AS updated_ms", "change AS state", "seq")
    return M.upserted(_items(spark, sf), new, ["id"], ["updated_ms", "seq"])


def upsert_tokens(spark, sf):
    """The tokens of users by user and token: the last time that each was registered."""
    empty = spark.createDataFrame([], "id long, token string, ms long")
    return M.upserted(empty, derived(spark, sf, "item_changes").select("id", "token", "ms", "seq"), ["id", "token"], ["ms", "seq"])


def seed_options(spark, sf):
    """The list of issues put in again over the keys that clicks have, each with its first reporter as its title: keys of the list get its
    titles, those that nobody has reported are new, and others (here that of unknown clicks) stay as they are."""
    clicks = derived(spark, sf, "issue_clicks")
    old = clicks.groupBy(F.coalesce("issue_key", F.lit("other")).alias("issue_key")).agg(F.concat(F.lit("user "), F.min("user_id").cast("string")).alias("title_en"), F.lit(0).alias("display_order"), F.lit(False).alias("is_active"))
    return M.upserted(old.where(F.col("issue_key") != ISSUES[1][0]), issue_options(spark).withColumn("seq", F.lit(1)), ["issue_key"], ["seq"])


def active_options(spark, sf):
    """What a signed-in user sees: the active issues in order, and how many of the user's own reports there are of each."""
    options = issue_options(spark).withColumn("is_active", F.col("display_order") != 4).where("is_active").select("issue_key", "title_en", "display_order")
    own = derived(spark, sf, "issue_clicks").where("user_id = 1").groupBy("issue_key").agg(F.count("*").alias("own_reports"))
    return options.join(own, "issue_key", "left").select("issue_key", "display_order", F.coalesce("own_reports", F.lit(0)).alias("own_reports")).orderBy("display_order")


def option_count_check(spark, sf):
    """Fails unless exactly the five issues that clicks are about are active."""
    n = derived(spark, sf, "issue_clicks").agg(F.count_distinct("issue_key").alias("n"))
    return n.select("n", F.when(F.col("n") == len(ISSUES), True).otherwise(F.raise_error(F.lit("not five issues"))).alias("fine"))


def normalized_by_sql(spark, sf):
    """Texts by the function that is registered for SQL."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION normalize_text(x STRING, most INT) RETURNS STRING RETURN CASE WHEN trim(x) = '' THEN NULL ELSE left(trim(x), greatest(1, most)) END")
    return derived(spark, sf, "item_changes").selectExpr("seq", "normalize_text(name, 8) AS name")


QUERIES = {f.__name__: f for f in (
    job_transitions, restart_recovery, queue_completion, job_predicates, latest_event, completed_once, observed_jobs, samples_without_job, average_item_time, queue_eta,
    insert_items, update_items, delete_items, delete_owned, upsert_items, upsert_tokens, seed_options, active_options, option_count_check, normalized_by_sql,
)}

_JOBS, _EVENTS, _CHANGES = ("WITH " + sql_of(t) for t in ("jobs", "job_events", "item_changes"))
_ITEMS = "items AS (SELECT c_custkey AS id, CAST(c_nationkey AS bigint) AS owner_id, c_name AS name, c_custkey % 2 = 0 AS favorite, CAST(0 AS bigint) AS updated_ms, 'ready' AS state FROM customer)"
_ACT, _END, _WAIT = "('preparing', 'processing', 'finalizing')", "('completed', 'failed', 'cancelled')", "('queued', 'paused', 'interrupted', 'retry-scheduled')"
_KEPT = "WITH " + sql_of("durations") + ", k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY supp_key ORDER BY ship_ms DESC, order_key DESC, line_no DESC, part_key DESC, duration_ms DESC) AS age FROM durations) WHERE age <= 20)"
_STEP = "greatest(10000, least(600000, CAST(floor(x * 0.35e0 + e * (1 - 0.35e0)) AS bigint)))"
_ETA = """a AS (SELECT *, CASE WHEN status IN ('preparing', 'processing', 'finalizing') THEN least(600000, 915148800000 - created_ms) ELSE 0 END AS elapsed FROM jobs),
  b AS (SELECT *, CASE WHEN progress > 0.01 AND elapsed > 0 THEN least(600000, greatest(10000, CAST(floor(45000.0e0 + floor(elapsed / progress) * 0.55e0) AS bigint))) ELSE 100000 END AS t FROM a),
  c AS (SELECT *, CASE WHEN total_processing_ms > 0 THEN least(600000, greatest(10000, CAST(floor(t * 0.7e0 + total_processing_ms * 0.3e0) AS bigint))) ELSE t END AS total FROM b),
  r AS (SELECT *, CASE WHEN status IN ('completed', 'failed', 'cancelled') THEN 0 WHEN status IN ('preparing', 'processing', 'finalizing') THEN greatest(0, total - elapsed) ELSE CAST(floor(total * greatest(0.0e0, 1 - progress)) AS bigint) END AS left_ms FROM c)"""
ORACLES = {
    "job_transitions": "WITH RECURSIVE " + sql_of("job_events") + """, e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ms, seq) AS n FROM job_events),
      s(job_id, n, status, attempt, progress, next_retry_ms, changes) AS (SELECT DISTINCT job_id, CAST(0 AS bigint), CAST(NULL AS varchar), CAST(0 AS bigint), CAST(0 AS double), CAST(NULL AS bigint), CAST(0 AS bigint) FROM e
      UNION ALL SELECT s.job_id, e.n,
        CASE m WHEN 'added' THEN 'queued' WHEN 'progress' THEN 'processing' WHEN 'completed' THEN 'completed' WHEN 'again' THEN 'retry-scheduled' WHEN 'failed' THEN 'failed' WHEN 'retry' THEN 'queued' WHEN 'cancelled' THEN 'cancelled' WHEN 'interrupted' THEN 'interrupted' WHEN 'removed' THEN NULL ELSE s.status END,
        CASE WHEN m IN ('added', 'removed') THEN 0 WHEN m IN ('again', 'failed') THEN greatest(1, s.attempt, e.attempt) WHEN m = 'retry' AND e.reset THEN 0 ELSE s.attempt END,
        CASE WHEN m IN ('added', 'removed', 'retry') THEN 0.0 WHEN m = 'progress' THEN least(1.0, greatest(s.progress, e.progress)) WHEN m = 'completed' THEN 1.0 ELSE s.progress END,
        CASE WHEN m IN ('added', 'removed', 'retry', 'completed', 'failed', 'cancelled') THEN NULL WHEN m = 'again' THEN e.ms + CASE greatest(1, s.attempt, e.attempt) WHEN 1 THEN 1500 ELSE 3000 END ELSE s.next_retry_ms END,
        s.changes + CASE WHEN m IS NULL THEN 0 ELSE 1 END
      FROM s JOIN e ON e.job_id = s.job_id AND e.n = s.n + 1, LATERAL (SELECT CASE
        WHEN e.kind = 'added' AND s.status IS NULL THEN 'added' WHEN s.status IS NULL THEN NULL
        WHEN e.kind = 'progress' AND s.status NOT IN ('completed', 'failed', 'cancelled') THEN 'progress' WHEN e.kind = 'completed' AND s.status <> 'completed' THEN 'completed'
        WHEN e.kind = 'failed' AND s.status NOT IN ('completed', 'cancelled') THEN CASE WHEN e.retryable AND greatest(1, s.attempt, e.attempt) < 3 THEN 'again' ELSE 'failed' END
        WHEN e.kind = 'retry' AND (s.status IN ('interrupted', 'retry-scheduled') OR (s.status = 'failed' AND e.reset)) THEN 'retry'
        WHEN e.kind = 'cancelled' AND s.status NOT IN ('completed', 'failed', 'cancelled') THEN 'cancelled' WHEN e.kind = 'interrupted' AND s.status IN ('preparing', 'processing', 'finalizing') THEN 'interrupted' WHEN e.kind = 'removed' THEN 'removed' END AS m))
      SELECT job_id, status, attempt, progress, next_retry_ms, changes FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n DESC) AS place FROM s) WHERE place = 1 AND status IS NOT NULL""",
    "restart_recovery": _JOBS + f" SELECT job_id, batch_id, CASE WHEN status IN {_ACT} THEN 'interrupted' ELSE status END AS status, row_number() OVER (PARTITION BY batch_id ORDER BY priority DESC, queue_position, created_ms, job_id) - 1 AS new_position FROM jobs",
    "queue_completion": _JOBS + f" SELECT item_id AS batch_id, count(*) FILTER (WHERE status NOT IN {_END}) = 0 AS ended, CASE WHEN count(*) FILTER (WHERE status NOT IN {_END}) > 0 THEN 'stopped' ELSE 'completed' END AS after_restart, count(*) >= 5 AND count(*) FILTER (WHERE status <> 'completed') = 0 AS announced FROM jobs GROUP BY 1",
    "job_predicates": _JOBS + f" SELECT job_id, status IN {_END} AS is_terminal, status IN {_ACT} AS is_active, status IN {_WAIT} AS is_pending, status = 'failed' AND attempt < 3 AS can_retry, status NOT IN {_END} AS can_cancel FROM jobs",
    "latest_event": "WITH " + sql_of("queue_events") + " SELECT batch_id, seq, type, job_id, ms FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY seq DESC) AS place FROM queue_events) WHERE place = 1",
    "completed_once": _EVENTS + " SELECT job_id, seq, ms AS completed_ms FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ms, seq) AS place FROM job_events WHERE kind = 'completed') WHERE place = 1",
    "observed_jobs": _JOBS + ", " + sql_of("queue_events") + " SELECT job_id, status FROM jobs WHERE job_id IN (SELECT job_id FROM queue_events WHERE job_id IS NOT NULL)",
    "samples_without_job": _KEPT + f", d AS (SELECT supp_key, list(duration_ms ORDER BY age DESC) AS d FROM k WHERE order_key NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) GROUP BY 1) SELECT supp_key, len(d) AS samples, list_reduce(list_prepend(CAST(100000 AS bigint), d), lambda e, x: {_STEP}) AS smoothed_ms FROM d",
    "average_item_time": _KEPT + f""", d AS (SELECT supp_key, list(duration_ms ORDER BY age DESC) AS d, CAST(floor(round(sum(duration_ms * weight) / sum(weight), 6)) AS bigint) AS w FROM k GROUP BY 1),
      s AS (SELECT supp_key, w, list_reduce(list_prepend(greatest(10000, least(600000, d[1])), d[2:]), lambda e, x: {_STEP}) AS m FROM d) SELECT supp_key, least(600000, greatest(10000, CAST(floor(w * 0.45e0 + m * 0.55e0) AS bigint))) AS average_ms FROM s""",
    "queue_eta": _JOBS + f", {_ETA} SELECT batch_id, count(*) FILTER (WHERE status IN {_ACT}) AS active, count(*) FILTER (WHERE status IN {_WAIT}) AS pending, count(*) FILTER (WHERE status IN {_END}) AS ended, CAST(coalesce(sum(left_ms) FILTER (WHERE status IN {_ACT}), 0) AS bigint) AS active_ms, CAST(sum(left_ms) AS bigint) AS remaining_ms FROM r GROUP BY 1",
    "insert_items": _CHANGES + f", {_ITEMS} SELECT * FROM items UNION ALL SELECT seq + 1000000, id % 25, nullif(trim(name), ''), coalesce(favorite, FALSE), ms, 'ready' FROM item_changes WHERE change = 'insert'",
    "update_items": _CHANGES + f""", {_ITEMS}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ms DESC, seq DESC) AS place FROM item_changes WHERE change = 'update') WHERE place = 1)
      SELECT i.id, i.owner_id, coalesce(nullif(trim(u.name), ''), i.name) AS name, coalesce(u.favorite, i.favorite) AS favorite, coalesce(u.ms, i.updated_ms) AS updated_ms, i.state FROM items i LEFT JOIN u USING (id)""",
    "delete_items": _CHANGES + f", {_ITEMS} SELECT id, owner_id FROM items WHERE id NOT IN (SELECT id FROM item_changes WHERE change = 'delete')",
    "delete_owned": f"WITH {_ITEMS} SELECT id, owner_id FROM items WHERE owner_id NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    "upsert_items": _CHANGES + f""", {_ITEMS}, u AS (SELECT * FROM (SELECT id + 700 AS id, id % 25 AS owner_id, trim(coalesce(name, 'none')) AS name, coalesce(favorite, FALSE) AS favorite, ms AS updated_ms, change AS state, row_number() OVER (PARTITION BY id ORDER BY ms DESC, seq DESC) AS place FROM item_changes) WHERE place = 1)
      SELECT * FROM items WHERE id NOT IN (SELECT id FROM u) UNION ALL SELECT id, owner_id, name, favorite, updated_ms, state FROM u""",
    "upsert_tokens": _CHANGES + " SELECT id, token, max(ms) AS ms FROM item_changes GROUP BY 1, 2",
    "active_options": "WITH " + sql_of("issue_clicks") + ", o(issue_key, display_order) AS (VALUES " + ", ".join(f"('{k}', {n})" for k, _, n in ISSUES if n != 4) + ") SELECT issue_key, display_order, (SELECT count(*) FROM issue_clicks c WHERE c.user_id = 1 AND c.issue_key = o.issue_key) AS own_reports FROM o",
    "seed_options": "WITH " + sql_of("issue_clicks") + ", o(issue_key, title_en, display_order, is_active) AS (VALUES " + ", ".join(f"('{k}', '{t}', {o}, TRUE)" for k, t, o in ISSUES) + f""")
      SELECT * FROM o UNION ALL SELECT coalesce(issue_key, 'other'), 'user ' || min(user_id), 0, FALSE FROM issue_clicks WHERE coalesce(issue_key, 'other') NOT IN (SELECT issue_key FROM o) GROUP BY 1""",
    "option_count_check": "WITH " + sql_of("issue_clicks") + " SELECT count(DISTINCT issue_key) AS n, count(DISTINCT issue_key) = 5 AS fine FROM issue_clicks",
    "normalized_by_sql": _CHANGES + " SELECT seq, nullif(substr(trim(name), 1, 8), '') AS name FROM item_changes",
}
