"""Device presence and lease expiry with typed state and event-time timers.

Keys share buckets, and a bucket has one state and one timer, so that Python asks the state store a few times a bucket and
micro-batch, not a few times a key. The state holds the open run of each key as columns; the timer in event time tells when
the first of their gaps is over. Rows of a key are put in order within a micro-batch. A gap that the rows themselves show
(the next event comes too late) ends there, so it makes no difference whether the watermark or the next event is first.
Events older than the last one are counted, but move nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUN = ("id", "started", "last", "n", "kind")
STATE = StructType([*(StructField(c, ArrayType(LongType())) for c in RUN[:4]), StructField("kind", ArrayType(StringType()))])
BUCKETS, NO_KEY = 256, -1  # events without a key have a bucket of their own


def _runs(held: pd.DataFrame, rows: pd.DataFrame, gap: int) -> tuple[pd.DataFrame, np.ndarray]:
    """The runs of held runs (columns of ``RUN``) and rows (id, at_ms, event_id, kind) in order of id and time, and which are the last of their id."""
    at = rows["id"].map(held.set_index("id")["last"]) if len(held) else pd.Series(np.nan, rows.index)
    old = (rows["at_ms"] < at).to_numpy()
    last = np.where(old, at.fillna(0), rows["at_ms"]).astype("int64")
    kind = np.where(old, rows["id"].map(held.set_index("id")["kind"]), rows["kind"]) if old.any() else rows["kind"]
    new = pd.DataFrame({"id": rows["id"], "started": last, "last": last, "n": 1, "kind": kind, "place": np.where(old, 1, 2), "event_id": rows["event_id"], "type": rows["kind"]})
    every = pd.concat([held.assign(place=0, event_id=0), new]) if len(held) else new
    every = every.sort_values(["id", "last", "place", "event_id", "type"], ignore_index=True)
    ids, times = every["id"].to_numpy(), every["last"].to_numpy()
    other = ids[1:] != ids[:-1]
    first = np.flatnonzero(np.r_[True, other | (times[1:] > times[:-1] + gap)])
    end = np.r_[first[1:], len(every)] - 1
    n = np.add.reduceat(every["n"].to_numpy(), first)
    found = pd.DataFrame({"id": ids[first], "started": every["started"].to_numpy()[first], "last": times[end], "n": n, "kind": every["kind"].to_numpy()[end]})
    return found, np.r_[other, True][end]


class Gaps(StatefulProcessor):
    """Runs of events less than ``gap`` ms apart: (key, started_ms, last_ms, events, last_type), when a run is over. Groups are buckets of keys."""

    def __init__(self, key: str, gap: int):
        self.key, self.gap = key, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE)

    def _held(self) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(RUN, self.open.get() if self.open.exists() else [[]] * len(RUN), strict=True)))

    def _hold(self, runs: pd.DataFrame) -> None:
        if len(runs):
            self.open.update(tuple(runs[c].tolist() for c in RUN))
            self.handle.registerTimer(int(runs["last"].min()) + self.gap)
        else:
            self.open.clear()

    def _out(self, bucket, runs: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(runs):
            named = runs["id"].astype("Int64") if bucket[0] != NO_KEY else pd.array([None] * len(runs), "Int64")
            yield pd.DataFrame({self.key: named, "started_ms": runs["started"], "last_ms": runs["last"], "events": runs["n"], "last_type": runs["kind"]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        if len(held):
            self.handle.deleteTimer(int(held["last"].min()) + self.gap)
        found, is_open = _runs(held, pd.concat(rows, ignore_index=True), self.gap)
        self._hold(found[is_open])
        yield from self._out(key, found[~is_open])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        ends = held["last"] + self.gap
        over = (ends < timerValues.getCurrentWatermarkInMs()) | (ends <= expiredTimerInfo.getExpiryTimeInMs())
        self._hold(held[~over])
        yield from self._out(key, held[over])

    def close(self) -> None:
        pass


def runs(events: DataFrame, key: str, gap_seconds: int, late: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """The runs of events (key, event_id, ts, type) by key, as they end. The state store must be ``ROCKS_DB``.

    A task holds a bucket's rows of a micro-batch and its open runs, so more keys in a micro-batch want more ``buckets``.
    """
    bucket = F.when(F.col(key).isNull(), NO_KEY).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)))
    timed = events.withWatermark("ts", late).select(bucket.alias("bucket"), F.coalesce(key, F.lit(0)).cast("bigint").alias("id"), "event_id", "ts", F.unix_millis("ts").alias("at_ms"), F.col("type").alias("kind"))
    schema = f"{key} bigint, started_ms bigint, last_ms bigint, events bigint, last_type string"
    return timed.groupBy("bucket").transformWithStateInPandas(Gaps(key, gap_seconds * 1000), StructType.fromDDL(schema), "Append", "EventTime")


def presence(events: DataFrame, gap_seconds: int = 120, late: str = "1 minute") -> DataFrame:
    """(device_id, online_from, offline_at, events): when devices were online."""
    return runs(events, "device_id", gap_seconds, late).selectExpr("device_id", "timestamp_millis(started_ms) AS online_from", f"timestamp_millis(last_ms + {gap_seconds * 1000}) AS offline_at", "events")


def lease_expiry(events: DataFrame, lease_seconds: int = 300, late: str = "1 minute") -> DataFrame:
    """(job_id, expired_at): leases that ended without a completing event."""
    ended = runs(events, "job_id", lease_seconds, late).where("last_type IS NULL OR last_type <> 'completed'")
    return ended.selectExpr("job_id", f"timestamp_millis(last_ms + {lease_seconds * 1000}) AS expired_at")
