"""Structured Streaming variants: replay protection, device sessions, signal ingest, activity counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.operators.ingest import SIGNAL_KEY, facts, hashed

CLOCK = "5 minutes"


def first_nonces(requests: DataFrame, at: str = "sent_at") -> DataFrame:
    """Requests whose (device_id, nonce) wasn't seen within the clock window; later ones than the watermark are dropped."""
    return requests.withWatermark(at, CLOCK).dropDuplicatesWithinWatermark(["device_id", "nonce"])


def new_signals(signals: DataFrame, at: str = "captured_at", late: str = "1 day") -> DataFrame:
    """One signal of each key within the watermark; null references are equal."""
    keyed = hashed(signals).withColumn("source_ref", F.coalesce("source_ref", F.lit("")))
    return keyed.withWatermark(at, late).dropDuplicatesWithinWatermark(SIGNAL_KEY)


def activity(rows: DataFrame, at: str, width: str = "30 days", late: str = "7 days") -> DataFrame:
    """(start, n): tumbling counts in event time."""
    counted = rows.withWatermark(at, late).groupBy(F.window(at, width)).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "n")


def presence(events: DataFrame, gap: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """(device_id, online_from, online_to, events): sessions of devices whose events are less than the gap apart."""
    counted = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "device_id").agg(F.count("*").alias("events"))
    return counted.select("device_id", F.col("session_window.start").alias("online_from"), F.col("session_window.end").alias("online_to"), "events")


def job_counters(events: DataFrame) -> DataFrame:
    """Update-mode counters of each job; the sink keeps the last row of a job."""
    return events.groupBy("job_id").agg(F.max("ts").alias("updated_at"), F.count(F.when(F.col("type") == "heartbeat", 1)).alias("heartbeats"), F.sum(F.when(F.col("type") == "page", F.col("pages")).otherwise(0)).alias("pages"))


def ingest_batches(signals: DataFrame, facts_path: str, checkpoint: str, then: Callable[[DataFrame], DataFrame] | None = None):
    """Start a query that appends the facts of new signals, micro-batch by micro-batch; a batch that runs again writes its own folder again."""

    def write(batch: DataFrame, number: int) -> None:
        found = facts(batch).where("reason is null").drop("reason")
        (then(found) if then else found).write.mode("overwrite").parquet(f"{facts_path}/batch={number}")

    return new_signals(signals).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def event_log(events: DataFrame, path: str, checkpoint: str):
    """A writer that appends events to a table partitioned by day."""
    return events.withColumn("day", F.to_date("ts")).writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint)
