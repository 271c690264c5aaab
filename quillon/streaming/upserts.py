"""Streams of clicks and queue events, folded batch by batch into tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import issues, retries, transitions
from ..sources.shared import shared_folder


def stream_folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def counted(rows: DataFrame) -> DataFrame:
    """Partial reports (n, first, last and the latest platform and version with their times) merged into one for each key."""
    return rows.groupBy("user_id", "issue_key").agg(
        F.sum("report_count").alias("report_count"), F.min("first_reported_ms").alias("first_reported_ms"), F.max("last_reported_ms").alias("last_reported_ms"),
        F.max(F.struct("latest.ms", "latest.click_id", "latest.platform")).alias("latest"), F.max("versioned").alias("versioned"),
    )


def partial(clicks: DataFrame) -> DataFrame:
    version = text.normalized(F.col("app_version"), 100)
    latest = F.struct("ms", "click_id", text.platform(F.col("platform")).alias("platform"))
    versioned = F.when(version.isNotNull(), F.struct("ms", "click_id", version.alias("app_version")))
    return clicks.groupBy("user_id", "issue_key").agg(F.count("*").alias("report_count"), F.min("ms").alias("first_reported_ms"), F.max("ms").alias("last_reported_ms"), F.max(latest).alias("latest"), F.max(versioned).alias("versioned"))


def counting_upsert(clicks: DataFrame, folder: str | None = None) -> DataFrame:
    """The reports that a stream of clicks makes, after all of it that is there.

    Each micro-batch adds its partial reports to a table, under the batch's number, so that a batch that is run again after a
    loss replaces itself; the reports are the partial ones merged. Counts, extremes and latest values merge in any order, so the
    result is that of the batch form.
    """
    spark = clicks.sparkSession
    folder = folder or stream_folder(spark)

    def add(batch: DataFrame, number: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{folder}/parts/batch={number}")

    query = clicks.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    merged = counted(spark.read.parquet(f"{folder}/parts"))
    return merged.select("user_id", "issue_key", "report_count", "first_reported_ms", "last_reported_ms", F.col("latest.platform").alias("platform"), F.col("versioned.app_version").alias("app_version"))


#: What an event makes of a job, and how far states have come; a job never goes back.
STATES = {"job-added": 1, "job-progress": 2, "job-failed": 3, "job-completed": 4}


def job_states(events: DataFrame, folder: str | None = None) -> DataFrame:
    """job_id, state, events, last_ms after a stream of queue events: the furthest state of each job, kept as a running
    aggregation in the state store; events without a job are not about one."""
    spark = events.sparkSession
    folder = folder or stream_folder(spark)
    rank = F.lit(0)
    for name, n in STATES.items():
        rank = F.when(F.col("type") == name, n).otherwise(rank)
    rows = events.where("job_id IS NOT NULL").groupBy("job_id").agg(F.max(rank).alias("n"), F.count("*").alias("events"), F.max("ms").alias("last_ms"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/states/{number % 2}")
        spark.createDataFrame([(number,)], "number long").write.mode("overwrite").parquet(f"{folder}/last")

    query = rows.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.read.parquet(f"{folder}/last").first()[0]
    word = F.lit("unknown")
    for name, n in STATES.items():
        word = F.when(F.col("n") == n, name.removeprefix("job-")).otherwise(word)
    return spark.read.parquet(f"{folder}/states/{last % 2}").select("job_id", word.alias("state"), "events", "last_ms")


def job_transitions(events: DataFrame, folder: str | None = None) -> DataFrame:
    """The states of the jobs after a stream of their events (see transitions), each kept in the state store: every batch puts
    the jobs that it has changed under its number, and the last one of each job counts."""
    spark = events.sparkSession
    folder = folder or stream_folder(spark)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changed/batch={number}")

    query = transitions.streamed(events).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    states = ["status", "attempt", "progress", "next_retry_ms", "changes"]
    rows = spark.read.parquet(f"{folder}/changed").groupBy("job_id").agg(F.max_by(F.struct(*states), "batch").alias("s"))
    return rows.select("job_id", "s.*").where("status IS NOT NULL")


#: The state store that timers and lists need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def job_retries(events: DataFrame, folder: str | None = None) -> DataFrame:
    """The states of the jobs after a stream of their events and after the retries that have come due meanwhile (see retries).

    A batch's changes are put under its number, so one that runs again replaces itself; a job can change twice in a batch, by
    its events and then by its timer, so of equal batches the larger number of changes counts.
    """
    spark = events.sparkSession
    folder = folder or stream_folder(spark)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changed/batch={number}")

    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        query = retries.streamed(events).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STORE[0])
        else:
            spark.conf.set(STORE[0], before)
    states = ["status", "attempt", "progress", "next_retry_ms", "changes", "fired", "last_fired_ms"]
    rows = spark.read.parquet(f"{folder}/changed").groupBy("job_id").agg(F.max_by(F.struct(*states), F.struct("batch", "changes", "fired")).alias("s"))
    return rows.select("job_id", "s.*").where("status IS NOT NULL")


def issue_notices(clicks: DataFrame, options: DataFrame, folder: str | None = None) -> DataFrame:
    """click_id, user_id, issue_key, heading, body: what each accepted change of a stream of clicks is announced with.

    Each batch meets two tables: the reports so far, which say whether a click is a reporter's first one, and the statistics and titles of
    the issues as they are after the batch. Both are read where the batch is written, under its number: a batch that runs
    again reads the reports of the batches before it and replaces what it has written.
    """
    spark = clicks.sparkSession
    folder = folder or stream_folder(spark)
    schema = partial(clicks).schema

    def tell(batch: DataFrame, number: int) -> None:
        paths = [f"{folder}/parts/batch={k}" for k in range(number)]
        parts = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
        before = parts.groupBy("user_id", "issue_key").agg(F.sum("report_count").alias("before"))
        partial(batch).write.mode("overwrite").parquet(f"{folder}/parts/batch={number}")
        after = counted(spark.read.schema(schema).parquet(*paths, f"{folder}/parts/batch={number}"))
        reports = after.withColumn("platform", F.col("latest.platform"))
        rows = issues.changes(batch).join(before, ["user_id", "issue_key"], "left")
        known = F.coalesce("before", F.lit(0))
        rows = rows.withColumns({"op": F.when(known + F.col("old_count") == 0, "INSERT").otherwise("UPDATE"), "old_count": known + F.col("old_count"), "new_count": known + F.col("new_count")})
        told = issues.notices(issues.accepted_changes(rows), issues.statistics(reports, options))
        told.write.mode("overwrite").parquet(f"{folder}/told/batch={number}")

    query = clicks.writeStream.foreachBatch(tell).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/told").drop("batch")
