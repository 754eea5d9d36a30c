"""Proportional stratified interleaving into shards.

Rows are shuffled by a seeded hash within their source and get the fractional rank (rank + offset) / rows of the source,
with rank from 0 and a seeded offset of the source between 0 and 1, so small sources don't all fall on the same places.
In the order of fractional ranks every stretch holds the sources in their proportions; cut into equal stretches, every
shard has the mixture, and shard sizes differ by one row at most.

Neither ranking sorts a source, or all rows, in one task: hashes (and then fractional ranks) fall into buckets of
bounded size, a small table of bucket counts gives each bucket's first rank, and a window ranks within a bucket.

Nulls: a null source is a source of its own; a null text has size 1 and the checksum of empty text; null doc_ids are
spread like others by the hash of the row. Repeated rows are placed once each (the order among them doesn't matter).
Texts of any length count whole; only their sizes and checksums are ranked. Equal fractional ranks are ordered by the
hash of the row and then its keys. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.session import cut

BUCKET_ROWS, LEAST_BUCKETS = 10_000, 1000  # rows ranked together at most, and buckets of small tables


def _running(n: str, *by: str, order: str) -> Column:
    return F.sum(n).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(n)


def ranked(rows: DataFrame, by: str | None, bucket: Column, order: list[str], name: str) -> DataFrame:
    """rows with their rank from 0 within ``by`` (or all): buckets must rise with the order and hold few rows each."""
    marked = rows.withColumn("_by", F.col(by) if by else F.lit(0)).withColumn("_bucket", bucket)
    counts = marked.groupBy(F.col("_by").alias("_of"), F.col("_bucket").alias("_in")).agg(F.count("*").alias("_n"))
    first = counts.withColumn("_first", _running("_n", "_of", order="_in")).drop("_n")
    inner = marked.withColumn("_inner", F.row_number().over(Window.partitionBy("_by", "_bucket").orderBy(*order)))
    joined = inner.join(first, F.col("_by").eqNullSafe(F.col("_of")) & (F.col("_bucket") == F.col("_in")))
    return joined.withColumn(name, F.col("_first") + F.col("_inner") - 1).drop("_by", "_of", "_bucket", "_in", "_first", "_inner")


def interleave(rows: DataFrame, shards: int, seed: int, source: str = "source", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """rows with shard (from 0) and slot (from 0, gapless in its shard). ``keys`` seed the shuffle and settle ties.

    Columns of ``rows`` with these two names are replaced; names that begin with an underscore are for this operator.
    """
    held = cut(rows.drop("shard", "slot").withColumn("_h", F.xxhash64(F.lit(seed), *keys)))
    total = held.count()
    buckets = max(1, min(total, LEAST_BUCKETS), -(-total // BUCKET_ROWS))
    part_of = lambda h: F.shiftrightunsigned(h, 33) / F.lit(1 << 31)
    by_hash = part_of("_h") * buckets
    inner = cut(ranked(held, source, F.floor(by_hash).cast("bigint"), ["_h", *keys], "_rank"))
    sizes = held.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("_rows"))
    mixed = inner.join(sizes, F.col(source).eqNullSafe(F.col("_source"))).drop("_source").withColumn("_part", (F.col("_rank") + part_of(F.xxhash64(F.lit(seed), F.lit("offset"), source))) / F.col("_rows"))
    placed = ranked(mixed, None, F.floor(F.col("_part") * buckets).cast("bigint"), ["_part", "_h", *keys], "_at")
    shard = F.expr(f"(_at * {shards}) div {max(total, 1)}")
    first = F.expr(f"((shard * {max(total, 1)}) + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_at") - first).drop("_h", "_rank", "_rows", "_part", "_at")


def shard_digest(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for docs (doc_id, text, source)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = interleave(rows, shards, seed, keys=("doc_id", "text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 17) -> None:
    """Write docs (doc_id, text, source, ...) under path/shard=N/, each shard in slot order.

    Rows are named by 128 bits of all their columns (maps as JSON); what is ranked are these names and sources alone, and
    whole rows are moved once, to their shard's place. Rows that repeat each other get a place each.
    """
    plain = [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in docs.dtypes]
    names = ("own_name1", "own_name2")
    named = docs.select(F.xxhash64(*plain).alias(names[0]), F.xxhash64(F.lit(1), *plain).alias(names[1]), F.struct(*docs.columns).alias("row"))
    rows = named.select(*names, F.col("row")["source"].cast("string").alias("source"))
    placed = interleave(rows, shards, seed, keys=names).select(*names, F.col("shard").alias("own_shard"), F.col("slot").alias("own_slot"))
    joined = named.dropDuplicates(list(names)).join(placed, list(names)).select("own_shard", "own_slot", "row.*")
    out = joined.drop("shard", "slot").withColumnsRenamed({"own_shard": "shard", "own_slot": "slot"})
    out.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
