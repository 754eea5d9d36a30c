"""From signals to decided facts as one incremental job: deduplication, extraction, resolution, append, exactly once.

Each micro-batch first writes the signals that no earlier batch has (their keys are what later batches look up), then the
facts extracted from these with what was decided about them. Both folders count once the batch's entry in the log is made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.operators import ingest as I
from pricetide.operators.resolve import persist_decisions
from pricetide.session import cut, dealt
from pricetide.sources.versioned import BatchLog

SIGNALS = "signal_id bigint, source_type string, source_ref string, raw_text string, captured_at timestamp, content_hash string"
FACTS = """ext_id string, signal_id bigint, item int, name string, type string, listing_type string, price_vnd bigint, price_basis string, area_m2 double,
  price_per_m2 double, confidence double, observed_at timestamp, month string, outcome string, reason string, property_id bigint, needs_review boolean"""


def decided(signals: DataFrame, entities: DataFrame, parents: DataFrame) -> DataFrame:
    """Facts of signals with outcome, reason and the property they are linked to; signals are read and extracted once."""
    none = F.array().cast("array<string>")
    found = I.facts(dealt(signals)).drop("reason", "needs_review", "raw_text", "item_text").withColumns({"aliases": none, "tags": none})
    extractions = cut(found.withColumn("ext_id", F.concat_ws("#", "signal_id", "item")))
    outcome = persist_decisions(extractions, entities, parents)
    rows = extractions.join(outcome, "ext_id").withColumn("needs_review", F.col("outcome") == "review")
    return rows.selectExpr(*(f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in FACTS.split(",")))


def fact_pipeline(signals: DataFrame, root: str, checkpoint: str, entities: DataFrame, parents: DataFrame, before_publishing: Callable[[int], None] | None = None):
    """A writer over a stream of signals (the columns of ``SIGNALS`` but the hash) into the log at ``root``.

    ``before_publishing`` is for tests of lost jobs. A new checkpoint starts new entries; signals that are known stay out.
    """
    own = hashlib.sha256(checkpoint.encode()).hexdigest()[:8]

    def write(batch: DataFrame, number: int) -> None:
        log, name = BatchLog(batch.sparkSession, root), f"{own}-{number}"
        if name in log.entries():
            return
        keys = log.read("signals", SIGNALS).select(*I.SIGNAL_KEY)
        folders = {kind: log.folder(kind, name) for kind in ("signals", "facts")}
        columns = [c.split()[0] for c in SIGNALS.split(",")]
        I.new_signals(batch, keys).select(*columns).write.parquet(folders["signals"])
        fresh = batch.sparkSession.read.schema(SIGNALS).parquet(folders["signals"])
        decided(fresh, entities, parents).write.parquet(folders["facts"])
        if before_publishing:
            before_publishing(number)
        log.publish(name, folders)

    return signals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def facts(log: BatchLog) -> DataFrame:
    return log.read("facts", FACTS)
