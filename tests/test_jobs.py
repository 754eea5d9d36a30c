"""Streams with timers, and the fact pipeline when a job is lost between writing and publishing."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from test_streams import drain, source

from pricetide.sources.versioned import BatchLog
from pricetide.streaming import pipeline as P
from pricetide.streaming import timers as S

T0 = dt.datetime(2024, 1, 1)
EVENTS = "event_id bigint, {} bigint, ts timestamp, type string"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(S.PROVIDER)
    spark.conf.set(S.PROVIDER, S.ROCKS_DB)
    yield
    spark.conf.set(S.PROVIDER, before)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_leases(spark, tmp_path, rocks):
    batches = [
        [(1, 1, at(0), "heartbeat"), (2, 2, at(0), "heartbeat"), (3, 3, at(0), "heartbeat"), (9, 4, at(0), "heartbeat")],
        [(4, 2, at(100), "completed"), (5, 3, at(3600), "heartbeat"), (10, 4, at(200), "heartbeat"), (11, 4, at(150), "completed")],
        [(6, 3, at(3700), "completed"), (7, 3, at(9000), "heartbeat")],
        [(8, 5, at(9400), "heartbeat")],
    ]
    got = drain(spark, S.lease_expiry(source(spark, tmp_path, batches, EVENTS.format("job_id"))), tmp_path)
    assert sorted((r.job_id, r.expired_at) for r in got) == [(1, at(300)), (3, at(300)), (3, at(9300)), (4, at(500))]


def test_presence(spark, tmp_path, rocks):
    rows = [(1, 1, at(0), "x"), (2, 1, at(60), "x"), (3, 1, at(600), "x"), (4, 2, at(5000), "x")]
    got = drain(spark, S.presence(source(spark, tmp_path, [rows[2:3] + rows[:2], rows[3:]], EVENTS.format("device_id"))), tmp_path)
    assert sorted((r.device_id, r.online_from, r.offline_at, r.events) for r in got) == [(1, at(0), at(180), 2), (1, at(600), at(720), 1)]


def by_rows(batches, seconds):
    """Runs of events, and those still open, by going through each key's rows."""
    done, state = [], {}
    for rows in batches:
        for _, key, ts, kind in sorted(rows, key=lambda e: (e[2], e[0])):
            run = state.get(key)
            if run and ts > run[1] + dt.timedelta(seconds=seconds):
                done.append((key, *run))
                run = None
            run = run or (ts, ts, 0, kind)
            state[key] = (run[0], ts, run[2] + 1, kind) if ts >= run[1] else (run[0], run[1], run[2] + 1, run[3])
    return done, [(key, *run) for key, run in state.items()]


def in_order(runs):
    return sorted(runs, key=lambda run: [(x is None, x or 0 if i < 4 else x or "") for i, x in enumerate(run)])


def ms(t):
    return (t - T0) // dt.timedelta(milliseconds=1) + 1_704_067_200_000


@pytest.mark.parametrize("buckets", [1, 64])
def test_keys_share_a_bucket(spark, tmp_path, rocks, buckets):
    """Late rows, equal times, gaps of just the limit, and events without a key or a type."""
    import random

    r = random.Random(7)
    when = lambda b: at(b + r.choice([0, 30, 60, 120, 180, 299, 300]) + r.choice([-60, 0, 0, 1]))
    batches = [[(b * 1000 + i, r.choice([None, *range(60)]), when(b), r.choice([None, "x", "y"])) for i in range(90)] for b in (100, 200, 300, 2000, 2100)]
    done, left = by_rows(batches, 120)
    assert len(done) > 60 and len({run[2] for run in left}) > 5
    events = source(spark, tmp_path, [*batches, [(1, 99, at(90_000), "z")]], EVENTS.format("device_id"))
    got = [(x.device_id, x.started_ms, x.last_ms, x.events, x.last_type) for x in drain(spark, S.runs(events, "device_id", 120, "10 minutes", buckets), tmp_path)]
    assert in_order(got) == in_order((k, ms(a), ms(b), n, kind) for k, a, b, n, kind in done + left)


def test_state_is_asked_by_bucket():
    """500 keys in a micro-batch: the state store is asked as often as for one."""
    import pandas as pd

    asked, value = [], []

    class Store:
        def getValueState(self, *_):
            return self

        def exists(self):
            asked.append("exists")
            return bool(value)

        def get(self):
            asked.append("get")
            return value[0]

        def update(self, new):
            asked.append("update")
            value[:] = [new]

        def registerTimer(self, at):
            asked.append("register")

        def deleteTimer(self, at):
            asked.append("delete")

    gaps = S.Gaps("job_id", 120_000)
    gaps.init(Store())
    for at_ms in (0, 200_000):
        rows = pd.DataFrame({"id": range(500), "event_id": range(500), "at_ms": at_ms, "kind": "x"})
        out = list(gaps.handleInputRows((3,), iter([rows[:200], rows[200:]]), None))
    assert len(asked) == 8 and [len(x) for x in out] == [500] and set(out[0]["last_ms"]) == {0}


UNEVEN = {
    "one long before": "CASE WHEN id = 0 THEN timestamp'2024-01-01' WHEN id < 1200 THEN timestamp'2024-01-20' + make_dt_interval(0, 0, 0, id * 40) ELSE timestamp'2024-01-30' + make_dt_interval(0, 0, 0, id * 3) END",
    "one time": "timestamp'2024-01-01' + make_dt_interval(0, 0, 0, id * 0)",
    "none": None,
}


@pytest.mark.parametrize("when", UNEVEN.values(), ids=UNEVEN)
def test_uneven_times_lose_no_event(spark, tmp_path, when):
    """A piece of few rows has fewer of them than a micro-batch takes files: it must not take those of the next one."""
    import duckdb

    from pricetide.plans import jobs, registry

    at = f"to_timestamp_ntz(date_format({when or 'null'}, 'yyyy-MM-dd HH:mm:ss'))"
    rows = spark.range(1800 if when else 0).selectExpr("id AS event_id", f"{at} AS ts", "(id * 7919) % 40 AS user_id", "element_at(array('view', 'purchase'), int(1 + id % 2)) AS event_type", "1.0D AS value", """'{"k": 1}' AS props""")
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    before = spark.conf.get(jobs.PARTITIONS)
    for name in ("T2_stream_presence", "T4_stream_lease_expiry"):
        got = registry.queries[name](spark, str(tmp_path)).collect()
        assert sorted(map(tuple, got)) == sorted(con.execute(registry.oracle[name]).fetchall()) and (len(got) > 40) == (when == UNEVEN["one long before"])
    assert spark.conf.get(jobs.PARTITIONS) == before


def test_streams_with_timers_take_no_more_partitions_than_cores_want(spark, tmp_path, monkeypatch):
    from pricetide.plans import jobs
    from pricetide.sources.domain import Domain

    seen = []
    monkeypatch.setattr(jobs, "_run", lambda d, df, mode: seen.append(int(d.spark.conf.get(jobs.PARTITIONS))))
    monkeypatch.setattr(jobs, "_in_order", lambda d, rows: rows)
    spark.range(1).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01' AS ts", "id AS user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props").write.parquet(str(tmp_path / "events.parquet"))
    before = spark.conf.get(jobs.PARTITIONS)
    try:
        for parts in (3, 600):
            spark.conf.set(jobs.PARTITIONS, parts)
            jobs._timed(Domain(spark, str(tmp_path)), lambda events: events)
            assert int(spark.conf.get(jobs.PARTITIONS)) == parts
    finally:
        spark.conf.set(jobs.PARTITIONS, before)
    assert seen == [3, 4 * spark.sparkContext.defaultParallelism]


def test_large_event_ids_keep_their_order():
    """Events of one time go by their ids, of which a double can't tell these two apart."""
    import pandas as pd

    held = pd.DataFrame({"id": [1], "started": [0], "last": [0], "n": [1], "kind": ["x"]})
    rows = pd.DataFrame({"id": [1, 1], "at_ms": [5, 5], "event_id": [2**53 + 1, 2**53], "kind": ["a", "b"]})
    found, is_open = S._runs(held, rows, 10)
    assert found.to_dict("records") == [{"id": 1, "started": 0, "last": 5, "n": 3, "kind": "a"}] and is_open.tolist() == [True]


SIGNALS = "signal_id bigint, source_type string, source_ref string, raw_text string, captured_at timestamp"
ENTITY = "property_id bigint, name string, project_name string, building_name string, house_number string, aliases array<string>, wiki_notes string, type string, area_m2 double"


def test_a_lost_batch_is_published_once(spark, tmp_path):
    text = lambda n: f"Bán nhà phố {60 + n}m2 giá {3 + n},5 tỷ, thương lượng"
    batches = [[(1, "web", None, text(1), T0), (2, "web", "r", text(2), T0)], [(3, "web", None, text(1), T0), (4, "web", "r", text(4), T0)], [(5, "web", "r", text(4), T0), (6, "web", "s", "hello", T0)]]
    root, checkpoint = f"file://{tmp_path}/log", str(tmp_path / "cp")
    entities = spark.createDataFrame([(77, text(2), None, None, None, [], None, "house", 62.0)], ENTITY)
    parents = spark.createDataFrame([], "name_normalized string")
    stream = source(spark, tmp_path, batches, SIGNALS)

    def lost(number):
        if number == 1:
            raise RuntimeError("lost")

    with pytest.raises(StreamingQueryException, match="lost"):
        P.fact_pipeline(stream, root, checkpoint, entities, parents, lost).trigger(availableNow=True).start().awaitTermination()
    log = BatchLog(spark, root)
    assert len(log.entries()) == 1
    assert spark.read.parquet(*[str(p) for p in (tmp_path / "log" / "facts").iterdir()]).count() > P.facts(log).count()  # written, but nobody reads it
    for _ in range(2):  # the second start finds nothing left
        P.fact_pipeline(stream, root, checkpoint, entities, parents).trigger(availableNow=True).start().awaitTermination()
    facts = {r.signal_id: r for r in P.facts(log).collect()}
    assert sorted(facts) == [1, 2, 4] and P.facts(log).count() == 3
    assert (facts[2].outcome, facts[2].property_id, facts[2].price_vnd) == ("linked", 77, 5_500_000_000)
    assert sorted(r.signal_id for r in log.read("signals", P.SIGNALS).collect()) == [1, 2, 4, 6]
    again = P.fact_pipeline(source(spark, tmp_path, [[(7, "web", "r", text(4), T0)]], SIGNALS), root, str(tmp_path / "cp2"), entities, parents)
    again.trigger(availableNow=True).start().awaitTermination()
    assert P.facts(log).count() == 3


def test_a_batch_is_published_once(spark, tmp_path):
    log = BatchLog(spark, f"file://{tmp_path}/b")
    assert log.entries() == {} and log.read("facts", "a int").count() == 0
    spark.range(2).select(F.col("id").cast("int").alias("a")).write.parquet(f"{tmp_path}/one")
    assert log.publish("x-0", {"facts": f"{tmp_path}/one"}) and not log.publish("x-0", {"facts": "other"})
    assert log.read("facts", "a int").count() == 2


def test_signals_are_extracted_once(spark, tmp_path):
    """A small file's signals go over all cores, and what is decided about them reads what was extracted."""
    rows = spark.range(64).selectExpr("id AS signal_id", "'web' AS source_type", "'r' AS source_ref", "concat('Bán nhà phố ', 60 + id, 'm2 giá 3,5 tỷ') AS raw_text", "timestamp'2024-01-01' AS captured_at", "string(id) AS content_hash")
    rows.coalesce(1).write.parquet(str(tmp_path / "signals"))
    signals = spark.read.parquet(str(tmp_path / "signals"))
    found = P.decided(signals, spark.createDataFrame([], ENTITY), spark.createDataFrame([], "name_normalized string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "triệu" not in plan and "raw_text" not in plan
    assert sorted((r.signal_id, r.area_m2, r.price_vnd, r.outcome) for r in found.collect()) == [(i, 60.0 + i, 3_500_000_000, "created") for i in range(64)]
