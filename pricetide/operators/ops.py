"""Collection operations: device and job state from an event log, leases, schedules and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.operators.dedup import first_by

ONLINE, LEASE, HEARTBEAT_LEASE, CLOCK = "2 minutes", "120 seconds", "300 seconds", "5 minutes"
ACTIVE = ("leased", "running", "needs_user_action")


def _span(text: str) -> Column:
    return F.expr(f"interval {text}")


def replay_rejected(requests: DataFrame, device: str = "device_id", nonce: str = "nonce", sent: str = "sent_at", received: str = "received_at") -> DataFrame:
    """Requests with ``verdict``: stale beyond the clock window, replay for a nonce seen before, else ok."""
    stale = (F.col(sent) < F.col(received) - _span(CLOCK)) | (F.col(sent) > F.col(received) + _span(CLOCK))
    marked = requests.withColumn("_stale", stale)
    order = F.row_number().over(Window.partitionBy(device, nonce, "_stale").orderBy(received, sent))
    return marked.withColumn("verdict", F.when(F.col("_stale"), "stale").when(order > 1, "replay").otherwise("ok")).drop("_stale")


def device_state(events: DataFrame, now: Column) -> DataFrame:
    """(device_id, last_seen, last_type, job_id, online): the latest event of each device."""
    last = F.max_by(F.struct("type", "job_id"), F.struct("ts", "event_id"))
    seen = events.groupBy("device_id").agg(F.max("ts").alias("last_seen"), last.alias("e"))
    return seen.select("device_id", "last_seen", F.col("e.type").alias("last_type"), "e.job_id", (F.col("last_seen") > now - _span(ONLINE)).alias("online"))


def job_state(events: DataFrame) -> DataFrame:
    """(job_id, state, started_at, updated_at, pages, heartbeats): a job's state after its latest event, and its counters."""
    kind = F.col("type")
    state = F.when(kind == "job_created", "queued").when(kind == "completed", "completed").when(kind == "user_action", "needs_user_action").otherwise("running")
    latest = F.max_by(state, F.struct("ts", "event_id"))
    return events.groupBy("job_id").agg(
        latest.alias("state"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("updated_at"),
        F.sum(F.when(kind == "page", F.col("pages")).otherwise(0)).alias("pages"),
        F.count(F.when(kind == "heartbeat", 1)).alias("heartbeats"),
    )


def expired(jobs: DataFrame, now: Column, lease: str = HEARTBEAT_LEASE) -> DataFrame:
    """Jobs with an active state whose lease is over become expired."""
    over = F.col("state").isin(*ACTIVE) & (F.col("updated_at") + _span(lease) < now)
    return jobs.withColumn("state", F.when(over, "expired").otherwise(F.col("state")))


def leasable(jobs: DataFrame, devices: DataFrame, k: int = 1) -> DataFrame:
    """(device_id, job_id, place): queued or expired jobs in order of priority for each device that may run their source.

    devices: device_id, scope (array of source ids; empty: all). jobs: job_id, source_id, state, priority, created_at.
    """
    open_jobs = jobs.where(F.col("state").isin("queued", "expired"))
    scoped = devices.select("device_id", F.explode("scope").alias("source_id")).join(open_jobs, "source_id")
    free = devices.where(F.size("scope") == 0).select("device_id")
    top = open_jobs.orderBy(F.desc("priority"), "created_at", "job_id").limit(k)
    every = free.join(F.broadcast(top)).select("device_id", *open_jobs.columns)
    both = scoped.select("device_id", *open_jobs.columns).unionByName(every)
    ranked = both.withColumn("place", F.row_number().over(Window.partitionBy("device_id").orderBy(F.desc("priority"), "created_at", "job_id")))
    return ranked.where(F.col("place") <= k).select("device_id", "job_id", "place")


def schedulable(sources: DataFrame, jobs: DataFrame, limit: int) -> DataFrame:
    """Enabled sources without an active job, the oldest run first."""
    busy = jobs.where(F.col("state").isin("queued", *ACTIVE)).select("source_id").distinct()
    return sources.where("enabled").join(busy, "source_id", "left_anti").orderBy(F.asc_nulls_first("last_run_at"), "source_id").limit(limit)


def schedule_summary(sources: DataFrame, jobs: DataFrame, limit: int) -> DataFrame:
    """considered, queued, skipped_active, skipped_limit."""
    busy = jobs.where(F.col("state").isin("queued", *ACTIVE)).select("source_id").distinct().withColumn("busy", F.lit(True))
    n = sources.where("enabled").join(busy, "source_id", "left").agg(F.count("*").alias("considered"), F.count("busy").alias("skipped_active"))
    free = F.col("considered") - F.col("skipped_active")
    return n.select("considered", F.least(free, F.lit(limit)).alias("queued"), "skipped_active", F.greatest(free - limit, F.lit(0)).cast("bigint").alias("skipped_limit"))


def source_status(events: DataFrame, source: str) -> DataFrame:
    """(source, last_completed, completions): from job completions."""
    done = events.where("type = 'completed'")
    return done.groupBy(source).agg(F.max("ts").alias("last_completed"), F.count("*").alias("completions"))


def newest(rows: DataFrame, at: str, k: int, *ties: str) -> DataFrame:
    return rows.orderBy(F.desc(at), *ties).limit(k)


def waiting_actions(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """The latest user-action event of each job that waits for one."""
    waiting = jobs.where("state = 'needs_user_action'").select("job_id")
    return first_by(events.where("type = 'user_action'").join(waiting, "job_id", "left_semi"), ["job_id"], F.desc("ts"), F.desc("event_id"))


def config_columns(config: str) -> dict[str, Column]:
    """A source's settings from JSON text: defaults where missing or malformed, numbers clamped to their ranges."""
    c = F.from_json(F.col(config), "max_pages int, max_depth int, max_chars int, delay_ms int, include array<string>, exclude array<string>", {"mode": "PERMISSIVE"})
    #: Default and range of each setting.
    ranges = {"max_pages": (10, 1, 50), "max_depth": (1, 0, 5), "max_chars": (12_000, 1_000, 120_000), "delay_ms": (1_000, 0, 60_000)}
    out = {k: F.greatest(F.least(F.coalesce(c[k], F.lit(d)), F.lit(hi)), F.lit(lo)) for k, (d, lo, hi) in ranges.items()}
    none = F.array().cast("array<string>")
    return out | {k: F.coalesce(c[k], none) for k in ("include", "exclude")}


def url_passes(url: Column, include: Column, exclude: Column) -> Column:
    """Whether a URL matches a pattern of ``include`` (if there is one) and none of ``exclude``."""
    hit = lambda patterns: F.exists(patterns, lambda p: F.regexp(url, p))
    return ((F.size(include) == 0) | hit(include)) & ~hit(exclude)
