"""Queries over what is wrong with scans, over candidates for a scan's mask, and the scalars around them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.num import clamp, lerp, percent, sigmoid, smoothstep
from ..operators import contexts
from ..operators import scans as S
from ..sources.tables import derived, given, sql_of

SCORES = ("brightness", "contrast", "sharpness", "mask", "framing")


def _issues(spark, sf):
    return derived(spark, sf, "scan_issues")


def issue_dedupe_rank(spark, sf):
    """Of the issues of a scan the strongest of each stage and code, in the order in which they are shown."""
    order = W.partitionBy("scan_id").orderBy(F.desc("w"), F.desc(S.priority(F.col("code_ix"))), F.desc("confidence"), "first", F.desc("stage"))
    return S.distinct_issues(_issues(spark, sf)).withColumn("rank", F.row_number().over(order)).select("scan_id", "stage", "code_ix", "severity", "confidence", "rank")


def primary_issue(spark, sf):
    return S.primary(S.distinct_issues(_issues(spark, sf)))


def _scans(spark, sf):
    """A row a scan: scores of its stages, number of issues, and whether one is invalid or blocks."""
    rows, code = _issues(spark, sf), F.element_at(F.array(*map(F.lit, S.CODES)), (F.col("code_ix") + 1).cast("int"))
    rows = rows.withColumn("code", code)
    scans = rows.groupBy("scan_id").agg(
        F.min("pre_score").alias("pre_score"), F.min("post_score").alias("post_score"), F.bool_or("with_background").alias("with_background"), F.count_if(F.col("confidence") > 0.6).alias("issues"),
        F.bool_or(F.col("code").isin(*S.INVALID) & (F.col("confidence") > 0.9)).alias("invalid"), F.bool_or((F.col("code").isin(*S.BLOCKING) | (F.col("severity") == "critical")) & (F.col("confidence") > 0.9)).alias("blocking"),
    )
    return scans.withColumn("score", S.final_score(F.col("pre_score"), F.col("post_score"), F.col("with_background")))


def final_scores(spark, sf):
    return _scans(spark, sf).select("scan_id", F.round("score", 6).alias("score"))


def scan_decisions(spark, sf):
    return S.decided(_scans(spark, sf)).select("scan_id", "issues", "invalid", "blocking", "decision")


def analytics_payload(spark, sf):
    """The nested result of a scan made flat; what a stage hasn't said is null."""
    rows = S.decided(_scans(spark, sf)).join(S.primary(S.distinct_issues(_issues(spark, sf))).select("scan_id", "code_ix", "severity"), "scan_id")
    pre, post = F.col("pre_score").isNotNull(), F.col("post_score").isNotNull()
    nested = rows.select(
        "scan_id",
        F.struct(
            F.col("decision").isin("accept", "accept-with-warning").alias("accepted"), "decision", F.struct("code_ix", "severity").alias("primaryIssue"), "issues",
            F.when(pre, F.struct(F.col("pre_score").alias("score"), F.struct((F.col("pre_score") / 2).alias("score")).alias("brightness"))).alias("pre"),
            F.when(post, F.struct(F.col("post_score").alias("score"), F.when(F.col("with_background"), F.struct((F.col("post_score") / 4).alias("score"))).alias("background"))).alias("post"),
        ).alias("result"),
    )
    r = lambda path, name: F.col(f"result.{path}").alias(name)
    return nested.select(
        "scan_id", r("accepted", "accepted"), r("decision", "decision"), r("issues", "issue_count"), r("primaryIssue.code_ix", "primary_issue_code"), r("primaryIssue.severity", "primary_issue_severity"),
        r("pre.score", "pre_score"), r("post.score", "post_score"), r("pre.brightness.score", "brightness_score"), r("post.background.score", "background_score"),
    )


def candidate_argmax(spark, sf):
    return S.highest(derived(spark, sf, "candidates"))


def candidate_best(spark, sf):
    return S.best_candidates(derived(spark, sf, "candidates"))


def results_in_order(spark, sf):
    """What came back of a batch of uploads, in the order in which it was asked for; failures are in a list of their own."""
    rows = derived(spark, sf, "candidates").select(F.col("image_id").alias("batch_id"), "ord", F.when(F.col("score").isNull(), "failed").otherwise("queued").alias("list"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("batch_id", "list").orderBy("ord")))


_SHARE = "(l_orderkey * 37 + l_linenumber * 11) % 1001"


def mask_confidence(spark, sf):
    """How sure one can be of a mask, of its backend's confidence, its share of the image, its largest part and its edges."""
    rows = given(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"CAST({_SHARE} AS double) / 1000 AS ratio", "CAST(l_partkey % 100 AS double) / 100 AS largest", "l_suppkey % 2 = 0 AS touches", "CAST(l_suppkey % 90 AS double) / 80 AS backend")
    ratio = F.col("ratio")
    share = F.when((ratio >= 0.003) & (ratio <= 0.975), 1.0).when(ratio < 0.003, clamp(ratio / 0.003, 0.0, 1.0)).otherwise(clamp((1 - ratio) / 0.025, 0.0, 1.0))
    total = clamp(F.col("backend"), 0.0, 1.0) * 0.58 + share * 0.2 + clamp(F.col("largest") * 1.35, 0.0, 1.0) * 0.14 + F.when(F.col("touches"), 0.55).otherwise(1.0) * 0.08
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.when(ratio == 0, 0.0).otherwise(clamp(total, 0.0, 1.0)), 6).alias("confidence"))


def contour_confidence(spark, sf):
    rows = given(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"CAST({_SHARE} AS double) / 1000 AS area", "l_partkey % 40 AS points", "CAST(l_suppkey % 100 AS double) / 100 AS fill", "CAST(l_linenumber * 3 AS double) AS perimeter", "l_suppkey % 2 = 0 AS touches", "l_partkey % 3 AS width")
    area, fill = F.col("area"), F.col("fill")
    by_area = F.when((area >= 0.02) & (area <= 0.9), 1.0).when(area < 0.02, clamp(area / 0.02, 0.0, 1.0)).otherwise(clamp((1 - area) / 0.1, 0.0, 1.0))
    by_fill = F.when(fill >= 0.12, clamp(fill / 0.55, 0.0, 1.0)).otherwise(clamp(fill / 0.12, 0.0, 1.0) * 0.55)
    total = by_area * 0.26 + F.least(F.lit(1.0), F.col("points") / 24) * 0.17 + by_fill * 0.17 + F.least(F.lit(1.0), F.col("perimeter") / 10) * 0.12 + F.when(F.col("touches"), 0.38).otherwise(1.0) * 0.18 + F.when(F.col("width") > 1, 0.1).otherwise(0.0)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(clamp(total, 0.0, 1.0), 6).alias("confidence"))


def number_helpers(spark, sf):
    """Clamping, blending, smooth steps, the saturated sigmoid and whole percent of a number."""
    rows = given(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "CAST(l_partkey % 200 AS double) / 100 - 0.5D AS x")
    x = F.col("x")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(clamp(x, 0.1, 0.9), 6).alias("clamped"), F.round(lerp(F.lit(2.0), F.lit(5.0), x), 6).alias("blended"), F.round(smoothstep(0.0, 1.0, x), 6).alias("smooth"), F.round(sigmoid(x * 50), 6).alias("sigmoid"), percent(x).alias("percent"))


_MESSY = "CASE event_id % 9 WHEN 0 THEN ' true ' WHEN 1 THEN '0' WHEN 2 THEN 'FALSE' WHEN 3 THEN '12.7' WHEN 4 THEN '-3' WHEN 5 THEN 'abc' WHEN 6 THEN '   ' WHEN 7 THEN '1' ELSE NULL END"
_TIMES = "CASE event_id % 5 WHEN 0 THEN concat(' 2024-0', CAST(1 + event_id % 9 AS varchar(9)), '-11T10:00:00Z') WHEN 1 THEN '2024-13-45' WHEN 2 THEN 'yesterday' WHEN 3 THEN '' ELSE '2023-05-06' END"
_STATES = "CASE event_id % 7 WHEN 0 THEN 'processing' WHEN 1 THEN 'completed' WHEN 2 THEN 'completed_with_errors' WHEN 3 THEN 'failed' WHEN 4 THEN 'cancelled' WHEN 5 THEN 'Processing' ELSE NULL END"
_VERSIONS = "CASE event_id % 4 WHEN 0 THEN concat('v', CAST(event_id % 20 AS varchar(9)), '.4') WHEN 1 THEN '17' WHEN 2 THEN 'none' ELSE NULL END"


def coerced_values(spark, sf):
    """Messy values as booleans, counts, texts and states, each with what stands for one that doesn't fit."""
    rows = given(spark, sf, "events").selectExpr("event_id", f"{_MESSY} AS v", f"{_STATES} AS s", f"{_VERSIONS} AS version")
    v, s = F.col("v"), F.coalesce("s", F.lit(""))
    return rows.select(
        "event_id", text.as_boolean(v).alias("flag"), text.as_count(v, 7).alias("count"), text.optional(v, 3).alias("text"), F.when(s.isin("processing", "completed", "failed", "cancelled"), s).otherwise("queued").alias("job_state"),
        F.when(s.isin("processing", "completed", "completed_with_errors", "failed", "cancelled"), s).otherwise("uploading").alias("batch_state"), text.major_version(F.col("version")).alias("major"),
    )


#: What may be stored for a user: whole, of other types, of another season, damaged, nothing, and with more in it.
_STORED = """CASE event_id % 8 WHEN 0 THEN '{"temperature":21.5,"weather":"Sunny","season":"Spring"}' WHEN 1 THEN '{"temperature":"12","weather":"Sunny","season":"Spring"}' WHEN 2 THEN '{"temperature":9,"weather":"Wind","season":"Fall"}' WHEN 3 THEN '{"temperature":'
  WHEN 5 THEN 'null' WHEN 6 THEN '{"temperature":9,"weather":5,"season":"Winter"}' WHEN 7 THEN '{"season":"Autumn","temperature":-3,"weather":"Fog","more":[1]}' END"""


def weather_contexts(spark, sf):
    """The weather that the reader of each stored document gets, and whether a default was put back."""
    stored = given(spark, sf, "events").selectExpr("event_id", "ts", f"{_STORED} AS document")
    return contexts.weather_contexts(stored, F.col("ts")).select("event_id", "temperature", "weather", "season", "put_back")


def valid_times(spark, sf):
    """The text of a time without blanks where it is one, else null."""
    t = text.trimmed(F.col("t"))
    return given(spark, sf, "events").selectExpr("event_id", f"{_TIMES} AS t").select("event_id", F.when(t.try_cast("timestamp").isNotNull(), t).alias("at"))


def required_texts(spark, sf):
    """Names that have to be there and short enough, with what is wrong with the others."""
    t = text.trimmed(F.col("name"))
    wrong = F.when(F.col("name").isNull(), "is invalid").when(t == "", "is required").when(F.length(t) > 12, "is too long")
    return derived(spark, sf, "item_changes").select("seq", F.when(wrong.isNull(), t).alias("name"), wrong.alias("wrong"))


def first_available(spark, sf):
    """The value of the first of several keys that a document has; one that is there and null counts."""
    docs = given(spark, sf, "events").selectExpr("event_id", "CASE event_id % 4 WHEN 0 THEN concat('{\"reportCount\":', CAST(event_id AS string), '}') WHEN 1 THEN concat('{\"report_count\":', CAST(event_id * 2 AS string), ',\"count\":1}') WHEN 2 THEN '{\"reportCount\":null,\"count\":5}' ELSE '{}' END AS d")
    pairs = F.from_json("d", "map<string,string>")
    pick = F.lit(None).cast("string")
    for key in ("count", "report_count", "reportCount"):
        pick = F.when(F.map_contains_key(pairs, key), pairs[key]).otherwise(pick)
    return docs.select("event_id", pick.try_cast("bigint").alias("value"))


def claims(spark, sf):
    """A member of a JSON document of claims."""
    docs = given(spark, sf, "customer").select("c_custkey", F.to_json(F.struct(F.struct(F.col("c_name").alias("email"), F.col("c_nationkey").alias("nation")).alias("user"))).alias("claims"))
    return docs.select("c_custkey", F.get_json_object("claims", "$.user.email").alias("email"))


def batch_eta(spark, sf):
    """The time of a batch before any of it is done: items, one hundred at most, by the time of one."""
    n = F.count("*")
    return derived(spark, sf, "jobs").groupBy("batch_id").agg((F.least(F.lit(100), n) * 100_000).cast("long").alias("estimate_ms"))


def stage_progress(spark, sf):
    """Progress of a stage (of a pipeline's event) as that of its job: between 0 and 1, and in whole percent."""
    rows = derived(spark, sf, "job_events").withColumn("p", F.col("progress") * 1.3 - 0.1)
    return rows.select("seq", F.round(clamp(F.col("p"), 0.0, 1.0), 6).alias("progress"), percent(F.col("p")).alias("percentage"))


def duration_texts(spark, sf):
    """Durations as a number with its unit, in short and in words; minutes are rounded up."""
    rows = given(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "CASE WHEN l_partkey % 5 = 0 THEN l_partkey % 90 * 500 WHEN l_partkey % 5 = 1 THEN l_partkey * 1000 ELSE l_partkey * 60000 + l_suppkey * 90000 END AS ms")
    total = F.ceil(F.col("ms") / 1000).cast("long")
    rows = rows.withColumns({"s": total, "d": F.floor(total / 86400).cast("long"), "h": F.floor(total % 86400 / 3600).cast("long"), "m": F.floor(total % 3600 / 60).cast("long")})
    d, h, m, s = (F.col(c) for c in "dhms")
    value = F.when(d > 0, d).when(h > 0, h).when(F.col("ms") >= 60000, F.greatest(F.lit(1), F.ceil(F.col("ms") / 60000))).when(m > 0, F.greatest(F.lit(1), F.ceil(F.col("ms") / 60000))).otherwise(F.greatest(F.lit(1), s)).cast("long")
    unit = F.when(d > 0, "day").when(h > 0, "hour").when((m > 0) | (F.col("ms") >= 60000), "minute").otherwise("second")
    part = lambda x, word: F.when(x > 0, F.concat(x.cast("string"), F.lit(word)))
    word = lambda x, name: F.when(x > 0, F.concat(x.cast("string"), F.when(x == 1, f" {name}").otherwise(f" {name}s")))
    short = F.slice(F.array_compact(F.array(part(d, "d"), part(h, "h"), part(m, "m"))), 1, 2)
    long = F.slice(F.array_compact(F.array(word(d, "day"), word(h, "hour"), word(m, "minute"))), 1, 2)
    least = F.greatest(F.lit(1), s)
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", value.alias("value"), unit.alias("unit"), F.when(F.size(short) > 0, F.concat_ws(" ", short)).otherwise(F.concat(least.cast("string"), F.lit("s"))).alias("short"),
        F.when(F.size(long) > 0, F.concat_ws(" ", long)).otherwise(word(least, "second")).alias("words"),
    )


def valid_jobs(spark, sf):
    """Jobs that can be restored: with an id, a known status, progress between 0 and 1 and at least one attempt."""
    rows = derived(spark, sf, "jobs").selectExpr("CASE WHEN job_id % 19 = 0 THEN NULL ELSE job_id END AS job_id", "CASE WHEN item_id % 23 = 0 THEN 'lost' ELSE status END AS status", "progress * 1.1D AS progress", "attempt")
    from ..sources.tables import STATUSES

    fine = F.col("job_id").isNotNull() & F.col("status").isin(*STATUSES) & F.col("progress").between(0, 1) & (F.col("attempt") >= 1)
    return rows.where(F.coalesce(fine, F.lit(False))).groupBy("status").agg(F.count("*").alias("jobs"), F.round(F.sum("progress"), 4).alias("progress"))


QUERIES = {f.__name__: f for f in (
    issue_dedupe_rank, primary_issue, final_scores, scan_decisions, analytics_payload, candidate_argmax, candidate_best, results_in_order, mask_confidence, contour_confidence, number_helpers,
    coerced_values, weather_contexts, valid_times, required_texts, first_available, claims, batch_eta, stage_progress, duration_texts, valid_jobs,
)}

_I = "WITH " + sql_of("scan_issues")
_W = "CASE severity WHEN 'critical' THEN 4 WHEN 'error' THEN 3 WHEN 'warning' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"
_P = "CASE WHEN code_ix = 33 THEN 100 ELSE 1000 - 10 * code_ix END"
_KEPT = f""", k0 AS (SELECT *, {_W} AS w, {_P} AS p, min(seq) OVER (PARTITION BY scan_id, stage, code_ix) AS first, row_number() OVER (PARTITION BY scan_id, stage, code_ix ORDER BY {_W} DESC, confidence DESC, seq) AS turn FROM scan_issues),
  k AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY w DESC, p DESC, confidence DESC, first, stage DESC) AS rank FROM k0 WHERE turn = 1)"""
_SCAN = """, n AS (SELECT scan_id, min(pre_score) AS pre, min(post_score) AS post, bool_or(with_background) AS bg, count(*) FILTER (WHERE confidence > 0.6) AS issues, bool_or(code_ix < 4 AND confidence > 0.9) AS invalid,
  bool_or((code_ix IN (4, 5, 6, 7) OR severity = 'critical') AND confidence > 0.9) AS blocking FROM scan_issues GROUP BY 1),
  f AS (SELECT *, CASE WHEN pre IS NULL AND post IS NULL THEN 0.0e0 WHEN post IS NULL THEN pre WHEN pre IS NULL THEN post ELSE (pre * 0.42e0 + post * (CASE WHEN bg THEN 0.58e0 ELSE 0.44e0 END)) / (0.42e0 + CASE WHEN bg THEN 0.58e0 ELSE 0.44e0 END) END AS score FROM n),
  d AS (SELECT *, CASE WHEN invalid THEN 'reject' WHEN blocking THEN 'retry' WHEN round(score, 9) >= 0.78 THEN CASE WHEN issues > 0 THEN 'accept-with-warning' ELSE 'accept' END WHEN round(score, 9) >= 0.66 THEN 'accept-with-warning' WHEN round(score, 9) >= 0.48 THEN 'retry' ELSE 'reject' END AS decision FROM f)"""
_C = "WITH RECURSIVE " + sql_of("candidates")
_L = "l_orderkey, l_linenumber, l_partkey"
_CL = "least(1.0e0, greatest(0.0e0, {0}))"
_EV = "WITH v AS (SELECT event_id, " + _MESSY + " AS v, " + _STATES + " AS s, " + _VERSIONS + " AS version FROM events)"
ORACLES = {
    "weather_contexts": f"""WITH d AS (SELECT event_id, CASE WHEN month(ts) IN (12, 1, 2) THEN 'Winter' WHEN month(ts) <= 5 THEN 'Spring' WHEN month(ts) <= 8 THEN 'Summer' ELSE 'Autumn' END AS now, CASE WHEN json_valid({_STORED}) THEN {_STORED} END AS t FROM events),
      h AS (SELECT *, coalesce(json_type(t, '$.temperature') IN ('DOUBLE', 'BIGINT', 'UBIGINT') AND json_type(t, '$.weather') = 'VARCHAR' AND json_extract_string(t, '$.season') IN ('Winter', 'Spring', 'Summer', 'Autumn'), FALSE) AS ok FROM d)
      SELECT event_id, CASE WHEN ok THEN CAST(json_extract_string(t, '$.temperature') AS double) ELSE CASE now WHEN 'Winter' THEN 8 WHEN 'Spring' THEN 20 WHEN 'Summer' THEN 32 ELSE 16 END END AS temperature,
        CASE WHEN ok THEN json_extract_string(t, '$.weather') ELSE CASE now WHEN 'Winter' THEN 'Cold' WHEN 'Spring' THEN 'Fresh' WHEN 'Summer' THEN 'Sunny' ELSE 'Cloudy' END END AS weather, CASE WHEN ok THEN json_extract_string(t, '$.season') ELSE now END AS season, NOT ok AS put_back FROM h""",
    "issue_dedupe_rank": f"{_I}{_KEPT} SELECT scan_id, stage, code_ix, severity, confidence, CAST(rank AS int) AS rank FROM k",
    "primary_issue": f"{_I}{_KEPT} SELECT scan_id, stage, code_ix, severity, confidence, issues FROM (SELECT *, count(*) OVER (PARTITION BY scan_id) AS issues FROM k) WHERE rank = 1",
    "final_scores": f"{_I}{_SCAN} SELECT scan_id, round(score, 6) AS score FROM f",
    "scan_decisions": f"{_I}{_SCAN} SELECT scan_id, issues, invalid, blocking, decision FROM d",
    "analytics_payload": f"""{_I}{_SCAN}{_KEPT} SELECT d.scan_id, decision IN ('accept', 'accept-with-warning') AS accepted, decision, issues AS issue_count, k.code_ix AS primary_issue_code, k.severity AS primary_issue_severity, pre AS pre_score, post AS post_score,
      pre / 2 AS brightness_score, CASE WHEN bg THEN post / 4 END AS background_score FROM d JOIN k ON k.scan_id = d.scan_id AND k.rank = 1""",
    "candidate_argmax": "WITH " + sql_of("candidates") + " SELECT image_id, coalesce(max(ord) FILTER (WHERE place = 1 AND score IS NOT NULL), 0) AS selected FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC NULLS LAST, ord) AS place FROM candidates) GROUP BY 1",
    "candidate_best": f"""{_C}, e AS (SELECT *, coalesce(score, 0.0) AS sc, row_number() OVER (PARTITION BY image_id ORDER BY ord) AS n FROM candidates),
      b(image_id, n, ord, sc, reliable, leakage, edge, samples) AS (SELECT DISTINCT image_id, CAST(0 AS bigint), CAST(NULL AS bigint), CAST(NULL AS double), CAST(NULL AS boolean), CAST(NULL AS double), CAST(NULL AS double), CAST(NULL AS double) FROM e
      UNION ALL SELECT b.image_id, e.n, CASE WHEN w THEN e.ord ELSE b.ord END, CASE WHEN w THEN e.sc ELSE b.sc END, CASE WHEN w THEN e.reliable ELSE b.reliable END, CASE WHEN w THEN e.leakage ELSE b.leakage END, CASE WHEN w THEN e.edge ELSE b.edge END, CASE WHEN w THEN e.samples ELSE b.samples END
      FROM b JOIN e ON e.image_id = b.image_id AND e.n = b.n + 1, LATERAL (SELECT e.valid AND (b.ord IS NULL OR e.sc - b.sc > 1e-6 OR (abs(e.sc - b.sc) <= 1e-6 AND ((e.reliable AND NOT b.reliable) OR (e.reliable = b.reliable AND
        (e.leakage - b.leakage < -1e-6 OR (abs(e.leakage - b.leakage) <= 1e-6 AND (e.edge - b.edge > 1e-6 OR (abs(e.edge - b.edge) <= 1e-6 AND e.samples > b.samples)))))))) AS w)),
      l AS (SELECT image_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC) AS place FROM b) WHERE place = 1), h AS (SELECT image_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY sc DESC, ord) AS place FROM e) WHERE place = 1)
      SELECT l.image_id, coalesce(l.ord, h.ord) AS selected FROM l JOIN h USING (image_id)""",
    "results_in_order": "WITH " + sql_of("candidates") + ", r AS (SELECT image_id AS batch_id, ord, CASE WHEN score IS NULL THEN 'failed' ELSE 'queued' END AS list FROM candidates) SELECT *, CAST(row_number() OVER (PARTITION BY batch_id, list ORDER BY ord) AS int) AS place FROM r",
    "mask_confidence": f"""WITH t AS (SELECT {_L}, CAST({_SHARE} AS double) / 1000 AS ratio, CAST(l_partkey % 100 AS double) / 100 AS largest, l_suppkey % 2 = 0 AS touches, CAST(l_suppkey % 90 AS double) / 80 AS backend FROM lineitem)
      SELECT {_L}, round(CASE WHEN ratio = 0 THEN 0.0e0 ELSE least(1.0e0, least(1.0e0, backend) * 0.58e0 + (CASE WHEN ratio < 0.003 THEN ratio / 0.003e0 WHEN ratio <= 0.975 THEN 1.0e0 ELSE (1 - ratio) / 0.025e0 END) * 0.2e0 + least(1.0e0, largest * 1.35e0) * 0.14e0 + (CASE WHEN touches THEN 0.55e0 ELSE 1.0e0 END) * 0.08e0) END, 6) AS confidence FROM t""",
    "contour_confidence": f"""WITH t AS (SELECT {_L}, CAST({_SHARE} AS double) / 1000 AS area, l_partkey % 40 AS points, CAST(l_suppkey % 100 AS double) / 100 AS fill, CAST(l_linenumber * 3 AS double) AS perimeter, l_suppkey % 2 = 0 AS touches, l_partkey % 3 AS width FROM lineitem)
      SELECT {_L}, round((CASE WHEN area < 0.02 THEN area / 0.02e0 WHEN area <= 0.9 THEN 1.0e0 ELSE (1 - area) / 0.1e0 END) * 0.26e0 + least(1.0e0, points / 24.0e0) * 0.17e0 + (CASE WHEN fill >= 0.12 THEN least(1.0e0, fill / 0.55e0) ELSE fill / 0.12e0 * 0.55e0 END) * 0.17e0
      + least(1.0e0, perimeter / 10) * 0.12e0 + (CASE WHEN touches THEN 0.38e0 ELSE 1.0e0 END) * 0.18e0 + (CASE WHEN width > 1 THEN 0.1e0 ELSE 0.0e0 END), 6) AS confidence FROM t""",
    "number_helpers": f"""WITH t AS (SELECT {_L}, CAST(l_partkey % 200 AS double) / 100 - 0.5e0 AS x FROM lineitem), u AS (SELECT *, {_CL.format('x')} AS c FROM t)
      SELECT {_L}, round(least(0.9e0, greatest(0.1e0, x)), 6) AS clamped, round(2.0e0 + 3.0e0 * x, 6) AS blended, round(c * c * (3 - 2 * c), 6) AS smooth, round(CASE WHEN x * 50 >= 30 THEN 1.0e0 WHEN x * 50 <= -30 THEN 0.0e0 ELSE 1 / (1 + exp(-(x * 50))) END, 6) AS sigmoid, CAST(floor(c * 100 + 0.5e0) AS int) AS percent FROM u""",
    "coerced_values": f"""{_EV} SELECT event_id, coalesce(lower(trim(v)) IN ('true', '1'), FALSE) AS flag, CAST(CASE WHEN try_cast(v AS double) IS NULL THEN 7 ELSE greatest(0, floor(try_cast(v AS double))) END AS bigint) AS count, nullif(substr(trim(v), 1, 3), '') AS text,
      CASE WHEN s IN ('processing', 'completed', 'failed', 'cancelled') THEN s ELSE 'queued' END AS job_state, CASE WHEN s IN ('processing', 'completed', 'completed_with_errors', 'failed', 'cancelled') THEN s ELSE 'uploading' END AS batch_state, try_cast(regexp_extract(coalesce(version, ''), '([0-9]+)', 1) AS int) AS major FROM v""",
    "valid_times": f"WITH v AS (SELECT event_id, trim({_TIMES}) AS t FROM events) SELECT event_id, CASE WHEN try_cast(t AS timestamptz) IS NOT NULL THEN t END AS at FROM v",
    "required_texts": "WITH " + sql_of("item_changes") + ", w AS (SELECT seq, trim(name) AS t, CASE WHEN name IS NULL THEN 'is invalid' WHEN trim(name) = '' THEN 'is required' WHEN length(trim(name)) > 12 THEN 'is too long' END AS wrong FROM item_changes) SELECT seq, CASE WHEN wrong IS NULL THEN t END AS name, wrong FROM w",
    "first_available": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN event_id * 2 ELSE NULL END AS value FROM events",
    "claims": "SELECT c_custkey, c_name AS email FROM customer",
    "batch_eta": "WITH " + sql_of("jobs") + " SELECT batch_id, least(100, count(*)) * 100000 AS estimate_ms FROM jobs GROUP BY 1",
    "stage_progress": "WITH " + sql_of("job_events") + f", p AS (SELECT seq, {_CL.format('progress * 1.3e0 - 0.1e0')} AS p FROM job_events) SELECT seq, round(p, 6) AS progress, CAST(floor(p * 100 + 0.5e0) AS int) AS percentage FROM p",
    "duration_texts": f"""WITH t AS (SELECT {_L}, CASE WHEN l_partkey % 5 = 0 THEN l_partkey % 90 * 500 WHEN l_partkey % 5 = 1 THEN l_partkey * 1000 ELSE l_partkey * 60000 + l_suppkey * 90000 END AS ms FROM lineitem),
      u AS (SELECT *, (ms + 999) // 1000 AS s FROM t), w AS (SELECT *, s // 86400 AS d, s % 86400 // 3600 AS h, s % 3600 // 60 AS m FROM u),
      x AS (SELECT *, list_filter([CASE WHEN d > 0 THEN d || 'd' END, CASE WHEN h > 0 THEN h || 'h' END, CASE WHEN m > 0 THEN m || 'm' END], lambda p: p IS NOT NULL)[1:2] AS a,
        list_filter([CASE WHEN d > 0 THEN d || CASE WHEN d = 1 THEN ' day' ELSE ' days' END END, CASE WHEN h > 0 THEN h || CASE WHEN h = 1 THEN ' hour' ELSE ' hours' END END, CASE WHEN m > 0 THEN m || CASE WHEN m = 1 THEN ' minute' ELSE ' minutes' END END], lambda p: p IS NOT NULL)[1:2] AS b FROM w)
      SELECT {_L}, CASE WHEN d > 0 THEN d WHEN h > 0 THEN h WHEN m > 0 OR ms >= 60000 THEN greatest(1, (ms + 59999) // 60000) ELSE greatest(1, s) END AS value, CASE WHEN d > 0 THEN 'day' WHEN h > 0 THEN 'hour' WHEN m > 0 OR ms >= 60000 THEN 'minute' ELSE 'second' END AS unit,
        CASE WHEN len(a) > 0 THEN array_to_string(a, ' ') ELSE greatest(1, s) || 's' END AS short, CASE WHEN len(b) > 0 THEN array_to_string(b, ' ') WHEN greatest(1, s) = 1 THEN '1 second' ELSE s || ' seconds' END AS words FROM x""",
    "valid_jobs": "WITH " + sql_of("jobs") + """, v AS (SELECT CASE WHEN item_id % 23 = 0 THEN 'lost' ELSE status END AS status, progress * 1.1e0 AS p FROM jobs WHERE job_id % 19 <> 0 AND attempt >= 1)
      SELECT status, count(*) AS jobs, round(sum(p), 4) AS progress FROM v WHERE status <> 'lost' AND p BETWEEN 0 AND 1 GROUP BY 1""",
}
