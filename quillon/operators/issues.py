"""Issue telemetry: the counting upsert, its views, constraints and change capture.

The lists of issues and the sums by issue are small, but how small is the data's affair: whether one is sent to all tasks is left to
its size when the query runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text


def fold_clicks(clicks: DataFrame) -> DataFrame:
    """One report for each user and issue: the count, the first and last time, the latest platform (even `unknown`) and the
    latest app version that is there. Partial sums are formed before the shuffle, so a busy user isn't a hot key."""
    at = F.struct("ms", "click_id")
    version = text.normalized(F.col("app_version"), 100)
    return clicks.groupBy("user_id", "issue_key").agg(
        F.count("*").alias("report_count"),
        F.min("ms").alias("first_reported_ms"),
        F.max("ms").alias("last_reported_ms"),
        F.max_by(text.platform(F.col("platform")), at).alias("platform"),
        F.max_by(version, F.when(version.isNotNull(), at)).alias("app_version"),
    )


def statistics(reports: DataFrame, options: DataFrame) -> DataFrame:
    """Every option with its reporters, reports, times and reporters by platform; options without reports count 0.

    The reports are summed by issue before the join: one row an issue meets the list of options.
    """
    sums = reports.groupBy("issue_key").agg(
        F.count("*").alias("reporters"),
        F.sum("report_count").alias("reports"),
        F.min("first_reported_ms").alias("first_reported_ms"),
        F.max("last_reported_ms").alias("last_reported_ms"),
        F.count_if(F.col("platform") == "ios").alias("ios"),
        F.count_if(F.col("platform") == "android").alias("android"),
    )
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return options.join(sums, "issue_key", "left").select(
        "issue_key", "title_en", "display_order", "is_active", zero("reporters", "unique_reporters"), zero("reports", "total_reports"),
        "first_reported_ms", "last_reported_ms", zero("ios", "ios_unique_reporters"), zero("android", "android_unique_reporters"),
    )


def details(reports: DataFrame, options: DataFrame, issue_key: str | None = None) -> DataFrame:
    """The reports with their issue's title; of one issue if a key that isn't blank is given."""
    if issue_key and issue_key.strip():
        reports = reports.where(F.col("issue_key") == issue_key.strip())
    return reports.join(options.select("issue_key", F.col("title_en").alias("issue_title")), "issue_key")


def totals(reports: DataFrame, issue_key: str) -> DataFrame:
    return reports.where(F.col("issue_key") == issue_key).agg(F.count("*").alias("unique_reporters"), F.coalesce(F.sum("report_count"), F.lit(0)).cast("long").alias("total_reports"))


def violations(reports: DataFrame, options: DataFrame) -> DataFrame:
    """rule, n: how many reports break each constraint; a rule that none breaks has no row."""
    known = options.select("issue_key").withColumn("known", F.lit(True))
    rows = reports.join(known, "issue_key", "left")
    rules = {
        "issue_key_exists": F.col("known").isNull(),
        "platform_known": ~F.col("platform").isin("ios", "android", "unknown"),
        "count_positive": F.col("report_count") < 1,
        "app_version_length": F.length("app_version") > 100,
        "repeated_reporter": F.col("report_count") > 3,
    }
    each = F.explode(F.array_compact(F.array(*[F.when(broken, F.lit(rule)) for rule, broken in rules.items()])))
    once = reports.groupBy("user_id", "issue_key").count().where("count > 1").select(F.lit("user_issue_unique").alias("rule"))
    return rows.select(each.alias("rule")).unionByName(once).groupBy("rule").agg(F.count("*").alias("n"))


def changes(clicks: DataFrame) -> DataFrame:
    """The row changes that the counting upsert makes, in order: an insert, then updates with the count before and after."""
    order = W.partitionBy("user_id", "issue_key").orderBy("ms", "click_id")
    count = F.row_number().over(order)
    return clicks.select("click_id", "user_id", "issue_key", F.when(count == 1, F.lit("INSERT")).otherwise(F.lit("UPDATE")).alias("op"), (count - 1).cast("long").alias("old_count"), count.cast("long").alias("new_count"))


def accepted_changes(rows: DataFrame) -> DataFrame:
    """Inserts, and updates whose count has grown: deletes and replays are skipped."""
    return rows.where((F.col("op") == "INSERT") | ((F.col("op") == "UPDATE") & (F.col("new_count") > F.coalesce("old_count", F.lit(0)))))


def response_json(reports: DataFrame, options: DataFrame) -> DataFrame:
    """user_id, issue_key, response: the nested JSON that a report is answered with."""
    sums = reports.groupBy("issue_key").agg(F.count("*").alias("uniqueReporters"), F.sum("report_count").alias("totalReports"))
    rows = reports.join(sums, "issue_key").join(options, "issue_key")
    report = F.struct(F.col("issue_key").alias("issueKey"), F.col("report_count").alias("reportCount"), F.col("first_reported_ms").alias("firstReportedAt"), F.col("last_reported_ms").alias("lastReportedAt"))
    body = F.struct(F.lit(True).alias("success"), F.struct(F.col("issue_key").alias("issueKey"), F.col("title_en").alias("title")).alias("issue"), report.alias("report"), F.struct("uniqueReporters", "totalReports").alias("statistics"))
    return rows.select("user_id", "issue_key", F.to_json(body).alias("response"))


def notices(rows: DataFrame, statistics_of: DataFrame) -> DataFrame:
    """user_id, issue_key, heading, color, body: what an accepted change is announced with. A missing statistic is 0."""
    found = rows.join(statistics_of.select("issue_key", "title_en", "unique_reporters", "total_reports"), "issue_key", "left")
    title = text.shortened(F.coalesce("title_en", "issue_key"), 40)
    fresh = F.col("op") == "INSERT"
    body = F.concat(title, F.lit(": "), F.coalesce("total_reports", F.lit(0)), F.lit(" by "), F.coalesce("unique_reporters", F.lit(0)))
    return found.select("click_id", "user_id", "issue_key", F.when(fresh, F.lit("New issue report")).otherwise(F.lit("Repeated issue report")).alias("heading"), body.alias("body"))
