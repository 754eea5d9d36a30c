"""Queries that run stateful streams and incremental jobs over several micro-batches."""

from pyspark.sql import functions as F

from pricetide.plans.registry import query
from pricetide.plans.review import planted_text
from pricetide.plans.streams import _run, in_pieces
from pricetide.session import stash_path
from pricetide.sources.domain import EVENTS
from pricetide.sources.versioned import BatchLog
from pricetide.streaming import pipeline as P
from pricetide.streaming import timers as S

LATE, GAP, LEASE = 60, 120, 300  # seconds
FILE_EVENTS = 250_000
PARTITIONS = "spark.sql.shuffle.partitions"


def _in_order(d, rows, pieces=4, files=4):
    """rows as a stream of several micro-batches that follow each other in time; more rows are more files, so a task's share stays the same.

    Every piece has as many files as a micro-batch takes: files of the next one would move the watermark past the rest of it.
    """
    first = F.coalesce(F.min("ts"), F.timestamp_seconds(F.lit(0)))  # there may be no rows
    path, (low, high, n) = stash_path(d.spark, "events"), rows.agg(first, F.coalesce(F.max("ts"), first), F.count("*")).first()
    step, files = (high - low) / pieces, max(files, -(-n // (pieces * FILE_EVENTS)))
    for i in range(pieces):
        own = (F.col("ts") >= low + i * step) & ((F.col("ts") < low + (i + 1) * step) if i < pieces - 1 else F.lit(True))
        rows.where(own).repartition(files).write.mode("append").parquet(path)
        short = (i + 1) * files - len(d.spark.read.schema(rows.schema).parquet(path).inputFiles())
        if short > 0:  # a file for each row without a time, which the stream leaves out
            d.spark.range(0, short, 1, short).select(*(F.lit(None).cast(c.dataType).alias(c.name) for c in rows.schema)).write.mode("append").parquet(path)
    return d.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path).where("ts IS NOT NULL")


def _timed(d, make):
    """Run a stream with timers, in the state store that they need; each of its partitions opens a store and Python in every micro-batch, so more than keep all cores busy are waste."""
    parts = min(int(d.spark.conf.get(PARTITIONS)), 4 * d.spark.sparkContext.defaultParallelism)
    before = {k: d.spark.conf.get(k) for k in (S.PROVIDER, PARTITIONS)}
    try:
        d.spark.conf.set(S.PROVIDER, S.ROCKS_DB)
        events = d.events().select("event_id", F.col("ts").cast("timestamp").alias("ts"), "device_id", "job_id", "type")
        stream = make(_in_order(d, events))
        d.spark.conf.set(PARTITIONS, parts)
        return _run(d, stream, "append")
    finally:
        for k, v in before.items():
            d.spark.conf.set(k, v)


RUNS = f"""{EVENTS}, m AS (SELECT *, epoch_us(ts) // 1000 AS ms, max(epoch_us(ts) // 1000) OVER () - {LATE * 1000} AS mark FROM ev),
g AS (SELECT *, CASE WHEN ms - lag(ms) OVER w > {{gap}} THEN 1 ELSE 0 END AS new FROM m WINDOW w AS (PARTITION BY {{key}} ORDER BY ms, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY {{key}} ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g),
runs AS (SELECT {{key}}, run, min(ms) AS started, max(ms) AS last, count(*) AS n, arg_max(type, (ms, event_id)) AS kind, any_value(mark) AS mark FROM r GROUP BY {{key}}, run),
ended AS (SELECT *, max(run) OVER (PARTITION BY {{key}}) > run OR last + {{gap}} < mark AS over FROM runs)"""


@query("T2_stream_presence", f"WITH {RUNS.format(key='device_id', gap=GAP * 1000)} SELECT device_id, started AS online_from_ms, last + {GAP * 1000} AS offline_at_ms, n AS events FROM ended WHERE over")
def stream_presence(d):
    """When devices were online: runs of events, each ended by a timer or by the next event."""
    return _timed(d, lambda events: S.presence(events, GAP, f"{LATE} seconds")).select("device_id", F.unix_millis("online_from").alias("online_from_ms"), F.unix_millis("offline_at").alias("offline_at_ms"), "events")


@query("T4_stream_lease_expiry", f"WITH {RUNS.format(key='job_id', gap=LEASE * 1000)} SELECT job_id, last + {LEASE * 1000} AS expired_at_ms FROM ended WHERE over AND kind <> 'completed'")
def stream_leases(d):
    """Leases that ran out before a completing event."""
    return _timed(d, lambda events: S.lease_expiry(events, LEASE, f"{LATE} seconds")).select("job_id", F.unix_millis("expired_at").alias("expired_at_ms"))


@query("T10_W10_R8_fact_pipeline", """SELECT doc_id AS signal_id, 0 AS item, CASE WHEN lang = 'en' THEN 'house' WHEN lang = 'de' THEN 'land' ELSE 'apartment' END AS type, CASE WHEN lang = 'fr' THEN 'rent' ELSE 'sale' END AS listing_type,
  (CASE WHEN lang = 'fr' THEN 1000000 ELSE 100000000 END * (10 * (1 + doc_id) + 5))::BIGINT AS price_vnd, (50 + doc_id)::DOUBLE AS area_m2, 'created' AS outcome, '2023-11' AS month FROM documents""")  # fmt: skip
def fact_pipeline(d):
    """A listing of every document, sent twice and in several micro-batches, ends as one decided fact each."""
    root = stash_path(d.spark, "facts")
    one = d.table("documents").select(F.col("doc_id").alias("signal_id"), F.lit("web").alias("source_type"), F.col("source").alias("source_ref"), planted_text().alias("raw_text"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("captured_at"))
    sent = in_pieces(one.unionByName(one), f"{root}/in")
    none = F.lit(None).cast("string")
    entities = d.properties().select("property_id", "name", F.col("project").alias("project_name"), none.alias("building_name"), none.alias("house_number"), F.array().cast("array<string>").alias("aliases"), none.alias("wiki_notes"), F.lit("house").alias("type"), F.col("size").alias("area_m2"))
    parents = d.properties().select(F.lower("project").alias("name_normalized"))
    P.fact_pipeline(sent, f"{root}/log", f"{root}/checkpoint", entities, parents).trigger(availableNow=True).start().awaitTermination()
    return P.facts(BatchLog(d.spark, f"{root}/log")).select("signal_id", "item", "type", "listing_type", "price_vnd", "area_m2", "outcome", "month")
