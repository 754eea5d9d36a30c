"""Queries on devices, jobs, schedules, signals and writes."""

from pyspark.sql import functions as F

from pricetide.operators import dedup as K
from pricetide.operators import ingest as I
from pricetide.operators import ops as O
from pricetide.plans.registry import query
from pricetide.sources.domain import EVENTS

TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
STATE = "CASE type WHEN 'job_created' THEN 'queued' WHEN 'completed' THEN 'completed' WHEN 'user_action' THEN 'needs_user_action' ELSE 'running' END"
JOBS = f"""{EVENTS}, jobs AS (SELECT job_id, arg_max({STATE}, (ts, event_id)) AS state, min(ts) AS started_at, max(ts) AS updated_at, sum(CASE WHEN type = 'page' THEN pages ELSE 0 END)::BIGINT AS pages, count(*) FILTER (WHERE type = 'heartbeat') AS heartbeats FROM ev GROUP BY 1)"""


def _text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _now(d):
    return F.lit(d.events().agg(F.max("ts")).first()[0])


@query("T1_replay_protection", f"WITH {EVENTS}, r AS (SELECT event_id, ts, row_number() OVER (PARTITION BY device_id, pages ORDER BY ts, event_id) AS k FROM ev) SELECT event_id, CASE WHEN k > 1 THEN 'replay' ELSE 'ok' END AS verdict FROM r")
def replay(d):
    sent = d.events().select("event_id", "device_id", F.col("pages").alias("nonce"), F.col("ts").alias("sent_at"), F.col("ts").alias("received_at"))
    return O.replay_rejected(sent).select("event_id", "verdict")


@query("T2_T3_device_state", f"""WITH {EVENTS} SELECT device_id, {TS.format('max(ts)')} AS last_seen, arg_max(type, (ts, event_id)) AS last_type, arg_max(job_id, (ts, event_id)) AS job_id, max(ts) > (SELECT max(ts) FROM ev) - INTERVAL 2 MINUTE AS online FROM ev GROUP BY 1""")
def devices(d):
    return O.device_state(d.events(), _now(d)).withColumn("last_seen", _text("last_seen"))


@query("T7_A32_job_state", f"WITH {JOBS} SELECT job_id, state, {TS.format('started_at')} AS started_at, {TS.format('updated_at')} AS updated_at, pages, heartbeats FROM jobs")
def jobs(d):
    return O.job_state(d.events()).withColumns({"started_at": _text("started_at"), "updated_at": _text("updated_at")})


@query("T4_expired_leases", f"WITH {JOBS} SELECT job_id, CASE WHEN state IN ('leased', 'running', 'needs_user_action') AND updated_at + INTERVAL 300 SECOND < (SELECT max(ts) FROM ev) THEN 'expired' ELSE state END AS state FROM jobs")
def expired(d):
    return O.expired(O.job_state(d.events()), _now(d)).select("job_id", "state")


@query("T5_P26_W14_leasable", f"""WITH {JOBS}, dev AS (SELECT user_id AS device_id, min(user_id * 31 + 1) AS own FROM events GROUP BY 1), o AS (SELECT job_id, job_id % 7 AS priority, started_at FROM jobs WHERE state = 'queued'),
e AS (SELECT device_id, o.* FROM dev JOIN o ON device_id % 2 = 0 OR o.job_id = own), r AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY priority DESC, started_at, job_id) AS place FROM e) SELECT device_id, job_id, place::INTEGER AS place FROM r WHERE place <= 3""")  # fmt: skip
def leasable(d):
    state = O.job_state(d.events()).select("job_id", F.col("job_id").alias("source_id"), "state", (F.col("job_id") % 7).alias("priority"), F.col("started_at").alias("created_at"))
    none = F.array().cast("array<bigint>")
    scoped = d.events().select("device_id").distinct().withColumn("scope", F.when(F.col("device_id") % 2 == 0, none).otherwise(F.array(F.col("device_id") * 31 + 1)))
    return O.leasable(state, scoped, 3)


@query("T6_W15_schedulable", f"WITH {JOBS}, s AS (SELECT s_suppkey AS source_id, s_acctbal >= 0 AS enabled FROM supplier) SELECT source_id FROM s WHERE enabled AND source_id NOT IN (SELECT job_id FROM jobs WHERE state <> 'completed') ORDER BY source_id LIMIT 20")
def schedulable(d):
    return O.schedulable(_sources(d), O.job_state(d.events()).withColumnRenamed("job_id", "source_id"), 20).select("source_id")


def _sources(d):
    return d.table("supplier").select(F.col("s_suppkey").alias("source_id"), (F.col("s_acctbal") >= 0).alias("enabled"), F.lit(None).cast("timestamp").alias("last_run_at"))


@query("A35_schedule_summary", f"""WITH {JOBS}, s AS (SELECT s_suppkey IN (SELECT job_id FROM jobs WHERE state <> 'completed') AS busy FROM supplier WHERE s_acctbal >= 0)
SELECT count(*) AS considered, least(count(*) FILTER (WHERE NOT busy), 20) AS queued, count(*) FILTER (WHERE busy) AS skipped_active, greatest(count(*) FILTER (WHERE NOT busy) - 20, 0) AS skipped_limit FROM s""")  # fmt: skip
def summary(d):
    return O.schedule_summary(_sources(d), O.job_state(d.events()).withColumnRenamed("job_id", "source_id"), 20)


@query("T8_source_status", f"WITH {EVENTS} SELECT job_id, {TS.format('max(ts)')} AS last_completed, count(*) AS completions FROM ev WHERE type = 'completed' GROUP BY 1")
def source_status(d):
    return O.source_status(d.events(), "job_id").withColumn("last_completed", _text("last_completed"))


@query("T9_W3_dashboard", f"WITH {EVENTS} (SELECT 'event' AS kind, event_id AS id FROM ev ORDER BY ts DESC, event_id LIMIT 30) UNION ALL (SELECT 'device', device_id FROM ev GROUP BY device_id ORDER BY max(ts) DESC, device_id LIMIT 10)")
def dashboard(d):
    e = d.events()
    latest = O.newest(e, "ts", 30, "event_id").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"))
    seen = O.newest(e.groupBy("device_id").agg(F.max("ts").alias("ts")), "ts", 10, "device_id").select(F.lit("device").alias("kind"), F.col("device_id").alias("id"))
    return latest.unionByName(seen)


@query("W16_J15_waiting_actions", f"WITH {JOBS}, w AS (SELECT event_id, ev.job_id, row_number() OVER (PARTITION BY ev.job_id ORDER BY ts DESC, event_id DESC) AS k FROM ev JOIN jobs USING (job_id) WHERE type = 'user_action' AND state = 'needs_user_action') SELECT job_id, event_id FROM w WHERE k = 1")
def waiting(d):
    return O.waiting_actions(d.events(), O.job_state(d.events())).select("job_id", "event_id")


@query("T11_activity", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def activity(d):
    return d.events().groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")


SIGNALS = "s AS (SELECT doc_id AS signal_id, source AS source_ref, sha256(trim(text)) AS content_hash FROM documents)"


@query("W10_X1_F13_new_signals", f"WITH {SIGNALS}, r AS (SELECT *, row_number() OVER (PARTITION BY source_ref, content_hash ORDER BY signal_id) AS k FROM s) SELECT signal_id, source_ref, content_hash FROM r WHERE k = 1 AND content_hash NOT IN (SELECT content_hash FROM s WHERE source_ref = 'src0') UNION ALL SELECT signal_id, source_ref, content_hash FROM r WHERE k = 1 AND source_ref <> 'src0' AND content_hash IN (SELECT content_hash FROM s WHERE source_ref = 'src0')")
def new_signals(d):
    known = I.hashed(d.signals()).where("source_ref = 'src0'")
    return I.new_signals(d.signals(), known).select("signal_id", "source_ref", "content_hash")


@query("W11_new_web_signals", "SELECT min(doc_id) AS signal_id, source AS source_ref FROM documents WHERE source <> 'src0' GROUP BY source")
def new_web(d):
    known = I.hashed(d.signals()).where("source_ref = 'src0'")
    return I.new_web_signals(d.signals(), known).select("signal_id", "source_ref")


@query("W12_X2_upsert_last_wins", "WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) SELECT o_custkey AS key, o_orderkey AS row_id, o_totalprice AS value FROM r WHERE k = 1")
def upsert(d):
    rows = d.table("orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("value"), F.struct("o_orderdate", "o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"))
    return K.upsert(rows.where("status = 'F'"), rows.where("status <> 'F'"), ["key"], "version").select("key", "row_id", "value")


@query("J10_null_safe_lookup", "WITH k AS (SELECT DISTINCT nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) SELECT c_custkey FROM customer, k WHERE nullif(c_mktsegment, 'BUILDING') IS NOT DISTINCT FROM seg")
def null_safe(d):
    own = d.table("customer").withColumn("seg", F.nullif("c_mktsegment", F.lit("BUILDING")))
    known = own.select(F.col("seg").alias("known")).distinct()
    return own.join(known, F.col("seg").eqNullSafe(F.col("known"))).select("c_custkey")


@query("J16_cache_lookup", "WITH c AS (SELECT n_nationkey AS k, CASE WHEN n_regionkey = 0 THEN NULL ELSE n_regionkey END AS v FROM nation WHERE n_nationkey < 20) SELECT s_suppkey, CASE WHEN c.k IS NULL THEN 'miss' WHEN v IS NULL THEN 'negative' ELSE 'hit' END AS outcome FROM supplier LEFT JOIN c ON s_nationkey = k")
def cache(d):
    held = d.table("nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("s_nationkey"), F.when(F.col("n_regionkey") != 0, F.col("n_regionkey")).alias("v"), F.lit(True).alias("known"))
    outcome = F.when(F.col("known").isNull(), "miss").when(F.col("v").isNull(), "negative").otherwise("hit")
    return d.table("supplier").join(held, "s_nationkey", "left").select("s_suppkey", outcome.alias("outcome"))


@query("W17_X4_last_records", "WITH r AS (SELECT user_id AS entity_id, event_type AS key, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC, key DESC) AS j FROM r WHERE k = 1) SELECT entity_id, key, event_id FROM l WHERE j <= 10")
def last_records(d):
    e = d.table("events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("key"), F.struct("ts", "event_id").alias("at"), "event_id")
    return I.merged_research(e.where("false"), e).select("entity_id", "key", "event_id")


@query("A25_P23_pending_geocode", "SELECT count(*) AS pending FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey WHERE s_nationkey >= 20 AND coalesce(nullif(s_name, ''), n_name) IS NOT NULL")
def pending(d):
    s = d.table("supplier").join(d.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").withColumn("geom", F.when(F.col("s_nationkey") < 20, F.struct("s_nationkey")))
    return s.where(F.col("geom").isNull() & F.coalesce(F.nullif("s_name", F.lit("")), "n_name").isNotNull()).agg(F.count("*").alias("pending"))


@query("A23_G3_location_sets", "SELECT l_suppkey AS id, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS locations FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def locations(d):
    places = d.table("customer").join(d.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    seen = d.table("lineitem").join(d.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(places, F.col("o_custkey") == F.col("c_custkey"))
    return seen.groupBy(F.col("l_suppkey").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("n_name")), ",").alias("locations"))
