"""Streams over files: what comes out, also of late and repeated rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pricetide.streaming import streams as S

T0 = dt.datetime(2024, 1, 1)


def drain(spark, df, tmp_path, mode="append"):
    got = []
    df.writeStream.outputMode(mode).foreachBatch(lambda b, n: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return got


def source(spark, tmp_path, batches, schema):
    """A file stream of one file a batch."""
    path = tmp_path / "in"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_first_nonces(spark, tmp_path):
    schema = "device_id string, nonce string, sent_at timestamp"
    at = lambda m: T0 + dt.timedelta(minutes=m)
    df = source(spark, tmp_path, [[("d", "a", at(0)), ("d", "b", at(1)), ("d", "a", at(2))], [("d", "a", at(3)), ("e", "a", at(3))]], schema)
    assert sorted((r.device_id, r.nonce) for r in drain(spark, S.first_nonces(df), tmp_path)) == [("d", "a"), ("d", "b"), ("e", "a")]


def test_new_signals(spark, tmp_path):
    schema = "source_type string, source_ref string, raw_text string, captured_at timestamp"
    df = source(spark, tmp_path, [[("web", None, " x ", T0), ("web", None, "x", T0)], [("web", None, "x", T0), ("web", "r", "x", T0)]], schema)
    assert sorted(r.source_ref for r in drain(spark, S.new_signals(df), tmp_path)) == ["", "r"]


def test_presence_and_activity(spark, tmp_path):
    schema = "device_id bigint, ts timestamp"
    rows = [(1, T0), (1, T0 + dt.timedelta(seconds=60)), (1, T0 + dt.timedelta(minutes=10)), (9, T0 + dt.timedelta(days=40))]
    df = source(spark, tmp_path, [rows, [(9, T0 + dt.timedelta(days=40, minutes=1))]], schema)
    got = {(r.device_id, r.online_from, r.events) for r in drain(spark, S.presence(df), tmp_path)}
    assert (1, T0, 2) in got and (1, T0 + dt.timedelta(minutes=10), 1) in got
    (tmp_path / "b").mkdir()
    counts = drain(spark, S.activity(source(spark, tmp_path / "b", [rows], schema), "ts"), tmp_path / "b")
    assert [r.n for r in counts] == [3]


def test_ingest_and_event_log(spark, tmp_path):
    schema = "signal_id bigint, source_type string, source_ref string, raw_text string, captured_at timestamp"
    df = source(spark, tmp_path, [[(1, "chat", "a", "Bán căn 60m2 giá 3 tỷ", T0), (2, "chat", "a", "Bán căn 60m2 giá 3 tỷ", T0), (3, "chat", "b", "hello", T0)]], schema)
    out, cp = str(tmp_path / "facts"), str(tmp_path / "cp2")
    S.ingest_batches(df, out, cp).trigger(availableNow=True).start().awaitTermination()
    assert [r.price_vnd for r in spark.read.parquet(out).collect()] == [3_000_000_000]
    (tmp_path / "e").mkdir()
    events = source(spark, tmp_path / "e", [[(1, T0)]], "id bigint, ts timestamp")
    S.event_log(events, str(tmp_path / "log"), str(tmp_path / "cp3")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).where(F.col("day") == T0.date()).count() == 1


def test_files_of_a_stream_are_bounded(spark, tmp_path, monkeypatch):
    """Four times the rows are four times the files in as many micro-batches."""
    from pricetide.plans import streams as P

    monkeypatch.setattr(P, "FILE_ROWS", 100)
    for n, files in ((300, 3), (1200, 12)):
        sent, path = P.in_pieces(spark.range(n), f"{tmp_path}/{n}"), f"{tmp_path}/{n}-out"
        sizes = []
        sent.writeStream.foreachBatch(lambda b, _, sizes=sizes: sizes.append(b.count())).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
        assert len(spark.read.parquet(f"{tmp_path}/{n}").inputFiles()) == files
        assert sum(sizes) == n and len(sizes) == 3
