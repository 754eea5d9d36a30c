"""Queries that run as streams over the event table to the end of what is there."""

import uuid

from pyspark.sql import functions as F

from pricetide.operators.dedup import first_by
from pricetide.plans.registry import query
from pricetide.session import scratch_root, stash
from pricetide.sources.domain import EVENTS
from pricetide.streaming import streams as S


def _stream(d):
    """The event table as a file stream, with the columns of ``Domain.events``."""
    static = d.table("events")
    raw = d.spark.readStream.schema(static.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d.folder}/events*")
    kind = F.element_at(F.create_map(*map(F.lit, ("signup", "job_created", "view", "heartbeat", "click", "page", "error", "user_action", "purchase", "completed"))), F.col("event_type"))
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("device_id"), (F.col("user_id") * 31 + F.dayofmonth("ts")).alias("job_id"), kind.alias("type"), F.get_json_object("props", "$.k").cast("int").alias("pages"))


def _run(d, df, mode):
    """Run a stream over all there is, every micro-batch into a folder of its own, and read what it wrote."""
    root = f"{scratch_root(d.spark).rstrip('/')}/pricetide-stream-{uuid.uuid4().hex}"

    def write(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/part={number}")

    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return d.spark.read.parquet(f"{root}/out").drop("part")


FILE_ROWS = 20_000


def in_pieces(rows, path, pieces=3):
    """rows as a stream of so many micro-batches, or one more; more rows are more files, so a task's share stays the same."""
    each = max(-(-rows.count() // (pieces * FILE_ROWS)), 1)
    rows.repartition(pieces * each).write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(path)


@query("T7_stream_job_counters", f"WITH {EVENTS} SELECT job_id, count(*) FILTER (WHERE type = 'heartbeat') AS heartbeats, sum(CASE WHEN type = 'page' THEN pages ELSE 0 END)::BIGINT AS pages FROM ev GROUP BY 1")
def job_counters(d):
    return first_by(_run(d, S.job_counters(_stream(d)), "update"), ["job_id"], F.desc("batch")).select("job_id", "heartbeats", "pages")


@query("T1_stream_first_nonces", f"WITH {EVENTS} SELECT DISTINCT device_id, pages AS nonce FROM ev")
def first_nonces(d):
    """Events in several micro-batches, all sent at one time: the state lets each nonce of a device through once."""
    split = stash(d.events().select("device_id", F.col("pages").alias("nonce"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("sent_at")).repartition(3), "nonces")
    sent = d.spark.readStream.schema(split.schema).option("maxFilesPerTrigger", 1).parquet(split.inputFiles()[0].rsplit("/", 1)[0])
    return _run(d, S.first_nonces(sent), "append").select("device_id", "nonce")


@query("T11_stream_activity", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def activity(d):
    out = _run(d, S.activity(_stream(d), "ts", "1 day"), "update")
    return first_by(out, ["start"], F.desc("batch")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n")
