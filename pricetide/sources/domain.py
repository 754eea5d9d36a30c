"""Domain views over the star-schema tables: observations, entities, locations, signals, jobs.

Every view is lazy; filters and columns of what is built on them reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Domain:
    """Views of the tables under a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def observations(self) -> DataFrame:
        """Facts with their entity names: inner join to the property, left joins to the dimensions."""
        fact, part = self.table("lineitem"), self.table("part")
        place = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.col("n_name").alias("area"))
        deal = F.when(F.col("l_linestatus") == "F", "transacted").when(F.col("l_linestatus") == "O", "asking").otherwise("unknown")
        listing = F.when(F.col("l_returnflag") == "R", "rent").when(F.col("l_returnflag") == "A", "sale").otherwise("unknown")
        return (
            fact.join(part, F.col("l_partkey") == F.col("p_partkey"))
            .join(place, F.col("l_suppkey") == F.col("s_suppkey"), "left")
            .select(
                F.col("l_partkey").alias("property_id"),
                F.col("l_suppkey").alias("source_id"),
                F.col("l_orderkey").alias("signal_id"),
                F.col("l_linenumber").alias("item"),
                F.col("l_extendedprice").alias("price"),
                F.col("l_quantity").alias("area_m2"),
                (F.col("l_extendedprice") / F.col("l_quantity")).alias("ppm2"),
                deal.alias("deal_status"),
                listing.alias("listing_type"),
                F.col("p_type").alias("property_type"),
                F.col("p_brand").alias("project"),
                F.col("p_name").alias("name"),
                "area",
                F.col("l_shipdate").alias("at"),
                (F.col("l_discount") > 0.08).alias("needs_review"),
            )
        )

    def reviewed(self) -> DataFrame:
        """Facts that statistics may use."""
        return self.observations().where("not needs_review and property_id is not null")

    def properties(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("property_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("project"), F.col("p_type").alias("property_type"), F.col("p_size").cast("double").alias("size"))

    def locations(self) -> DataFrame:
        """The tree of places: (id, name, parent_id); regions are the roots."""
        low = self.table("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"))
        top = self.table("region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id"))
        return low.unionByName(top)

    def signals(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("signal_id"), F.lit("web").alias("source_type"), F.col("source").alias("source_ref"), F.col("text").alias("raw_text"))

    def events(self) -> DataFrame:
        """Device events: a device has a job a day of the month; an error blocks it, a purchase completes it."""
        kind = F.element_at(F.create_map(*map(F.lit, ("signup", "job_created", "view", "heartbeat", "click", "page", "error", "user_action", "purchase", "completed"))), F.col("event_type"))
        return self.table("events").select("event_id", "ts", F.col("user_id").alias("device_id"), (F.col("user_id") * 31 + F.dayofmonth("ts")).alias("job_id"), kind.alias("type"), "value", F.get_json_object("props", "$.k").cast("int").alias("pages"))


#: The observations as SQL, for oracles.
OBS = """obs AS (
  SELECT l_partkey AS property_id, l_suppkey AS source_id, l_orderkey AS signal_id, l_linenumber AS item, l_extendedprice AS price, l_quantity AS area_m2,
    l_extendedprice / l_quantity AS ppm2,
    CASE l_linestatus WHEN 'F' THEN 'transacted' WHEN 'O' THEN 'asking' ELSE 'unknown' END AS deal_status,
    CASE l_returnflag WHEN 'R' THEN 'rent' WHEN 'A' THEN 'sale' ELSE 'unknown' END AS listing_type,
    p_type AS property_type, p_brand AS project, p_name AS name, n_name AS area, l_shipdate AS seen_at, l_discount > 0.08 AS needs_review
  FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey),
reviewed AS (SELECT * FROM obs WHERE NOT needs_review AND property_id IS NOT NULL)"""

#: The device events as SQL.
EVENTS = """ev AS (
  SELECT event_id, ts, user_id AS device_id, user_id * 31 + day(ts) AS job_id, value,
    CASE event_type WHEN 'signup' THEN 'job_created' WHEN 'view' THEN 'heartbeat' WHEN 'click' THEN 'page' WHEN 'error' THEN 'user_action' WHEN 'purchase' THEN 'completed' END AS type,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS pages
  FROM events)"""

#: Extraction records over the facts: SQL twin of ``extractions``.
EXTRACTIONS = f"""{OBS},
ext AS (
  SELECT signal_id, item, property_id AS ref, CASE WHEN property_type = 'PROMO' THEN NULL ELSE name END AS name, CASE WHEN item % 3 = 0 THEN project END AS project_name, NULL::VARCHAR AS building_name,
    CASE WHEN item = 6 THEN property_id::VARCHAR END AS house_number, CASE WHEN property_type = 'PROMO' AND item > 4 THEN area END AS location_text,
    CASE WHEN property_type = 'SMALL' THEN 'house' ELSE 'apartment' END AS type, listing_type, CASE WHEN area_m2 < 3 THEN NULL ELSE round(price)::BIGINT END AS price_vnd,
    CASE WHEN item = 7 THEN 'unknown' WHEN item = 1 THEN 'per_m2' ELSE 'total' END AS price_basis, CASE WHEN area_m2 < 2 OR item = 2 THEN NULL ELSE area_m2 END AS area_m2, (100 - source_id % 71) / 100.0::DOUBLE AS confidence
  FROM obs)"""


def extractions(d: Domain) -> DataFrame:
    """Extraction records made of the facts, with gaps, so that every rule of the gate has work."""
    o, c = d.observations(), F.col
    promo = c("property_type") == "PROMO"
    return o.select(
        "signal_id",
        "item",
        c("property_id").alias("ref"),
        F.when(~promo, c("name")).alias("name"),
        F.when(c("item") % 3 == 0, c("project")).alias("project_name"),
        F.lit(None).cast("string").alias("building_name"),
        F.when(c("item") == 6, c("property_id").cast("string")).alias("house_number"),
        F.when(promo & (c("item") > 4), c("area")).alias("location_text"),
        F.when(c("property_type") == "SMALL", "house").otherwise("apartment").alias("type"),
        "listing_type",
        F.when(c("area_m2") >= 3, F.round("price").cast("bigint")).alias("price_vnd"),
        F.when(c("item") == 7, "unknown").when(c("item") == 1, "per_m2").otherwise("total").alias("price_basis"),
        F.when((c("area_m2") >= 2) & (c("item") != 2), c("area_m2")).alias("area_m2"),
        ((100 - c("source_id") % 71) / F.lit(100.0)).alias("confidence"),
    )
