"""Statistics of places by segment as mergeable state, kept as a table and rolled up a tree.

State is one row for each place, segment and bucket of value: the count, and the least and largest value in it. It is merged
by adding, so new facts alone bring it up to date, and any order of increments gives the same state. Buckets are ``PER_E``
to a factor of e; a quantile is the middle of its bucket's least and largest value, so it is off by under one part in
``PER_E`` and exact where a bucket holds one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricetide.session import cut
from pricetide.sources.versioned import VersionedTable

PER_E = 64
SEGMENT = ["property_type", "deal_status"]
STATE = "place string, property_type string, deal_status string, bucket bigint, n bigint, lo double, hi double"
SHARES = {"p25": 0.25, "median": 0.5, "p75": 0.75}
_merged = [F.sum, F.min, F.max]


def state_of(rows: DataFrame, place: str, value: str = "ppm2") -> DataFrame:
    """The state of facts with a positive value and a place."""
    v = F.col(value).cast("double")
    sound = rows.where((v > 0) & (v < float("inf")) & F.col(place).isNotNull())
    return sound.groupBy(F.col(place).alias("place"), *SEGMENT, F.floor(F.ln(v) * PER_E).cast("bigint").alias("bucket")).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))


def merged(states: DataFrame) -> DataFrame:
    return states.groupBy("place", *SEGMENT, "bucket").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def location_table(spark: SparkSession, root: str, parts: int = 16) -> VersionedTable:
    return VersionedTable(spark, root, STATE, ["place"], parts)


def add_facts(table: VersionedTable, facts: DataFrame, place: str, value: str = "ppm2") -> list[int]:
    """Bring the table up to date with new facts; only parts of their places are written again."""
    return table.merge(state_of(facts, place, value), merged)


def ancestors(places: DataFrame) -> DataFrame:
    """(below, id): each place with itself and all above it, to any depth; places are (id, parent_id). A cycle is an error."""
    parents = places.where("parent_id IS NOT NULL").select(F.col("id").alias("_id"), F.col("parent_id").alias("_parent"))
    level = cut(places.select(F.col("id").alias("below"), "id"))
    reach = level
    while True:
        level = cut(level.join(parents, F.col("id") == F.col("_id")).select("below", F.col("_parent").alias("id")))
        around = level.where("below = id").limit(5).collect()
        if around:
            raise ValueError(f"places are their own ancestors: {[r['id'] for r in around]}")
        if level.isEmpty():
            return reach
        reach = reach.unionByName(level)


def rolled_up(state: DataFrame, places: DataFrame) -> DataFrame:
    """The state of every place (id, parent_id) with all those below it; state's places are ids."""
    reach = ancestors(places)
    return merged(state.join(reach, F.col("place") == F.col("below")).drop("place", "below").withColumnRenamed("id", "place"))


def summary(state: DataFrame) -> DataFrame:
    """place, segment, n, min, max and quartiles from buckets, of which a segment has some thousands at most."""
    by = Window.partitionBy("place", *SEGMENT)
    upto = F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    placed = state.withColumns({"upto": upto, "all": F.sum("n").over(by)})
    rank = lambda q: F.ceil(F.col("all") * q)
    holds = lambda q: (F.col("upto") >= rank(q)) & (F.col("upto") - F.col("n") < rank(q))
    found = [F.max(F.when(holds(q), (F.col("lo") + F.col("hi")) / 2)).alias(name) for name, q in SHARES.items()]
    return placed.groupBy("place", *SEGMENT).agg(F.sum("n").alias("n"), F.min("lo").alias("min"), F.max("hi").alias("max"), *found)
