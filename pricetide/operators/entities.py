"""Entity lists and details: projects, buildings, properties and their observation counts and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.operators import stats as S
from pricetide.operators.location_stats import ancestors
from pricetide.operators.quantiles import medians


def counted(entities: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Entities with their number of rows, zero included; rows are counted before the join."""
    n = rows.groupBy(key).agg(F.count("*").alias("n_obs"))
    return entities.join(n, key, "left").withColumn("n_obs", F.coalesce("n_obs", F.lit(0)).cast("bigint"))


def sale_distribution(rows: DataFrame, key: str) -> DataFrame:
    """Last time seen and distribution of sale ppm2 over reviewed rows."""
    sale = F.when((F.col("listing_type") == "sale") & ~F.col("needs_review"), F.col("ppm2"))
    return rows.groupBy(key).agg(F.max("at").alias("last_seen"), *S.distribution(sale))


def top_observed(entities: DataFrame, rows: DataFrame, key: str, k: int, *ties: str) -> DataFrame:
    return counted(entities, rows, key).orderBy(F.desc("n_obs"), *ties).limit(k)


def list_properties(properties: DataFrame, rows: DataFrame, k: int = 100) -> DataFrame:
    """The k most observed properties with details; rows of the others are dropped by a semi-join before aggregation."""
    page = top_observed(properties, rows, "property_id", k, "name", "property_id")
    detail = sale_distribution(rows.join(page.select("property_id"), "property_id", "left_semi"), "property_id")
    return page.join(detail, "property_id", "left")


def list_projects(properties: DataFrame, rows: DataFrame) -> DataFrame:
    """Project, buildings, properties and observations, each branch aggregated before the join."""
    dims = properties.groupBy("project").agg(F.countDistinct("property_type").alias("n_buildings"), F.countDistinct("property_id").alias("n_properties"))
    return counted(dims, rows.join(properties.select("property_id", "project"), "property_id") if "project" not in rows.columns else rows, "project")


def list_buildings(properties: DataFrame, rows: DataFrame) -> DataFrame:
    keys = ["project", "property_type"]
    dims = properties.groupBy(*keys).agg(F.countDistinct("property_id").alias("n_properties"))
    n = rows.groupBy(*keys).agg(F.count("*").alias("n_obs"))
    return dims.join(n, keys, "left").withColumn("n_obs", F.coalesce("n_obs", F.lit(0)).cast("bigint"))


def project_detail(properties: DataFrame, rows: DataFrame, project: str) -> DataFrame:
    """One project's summary; the filter comes first, so any project can be asked for."""
    return list_projects(properties.where(F.col("project") == project), rows.where(F.col("project") == project))


def property_points(rows: DataFrame, property_id: int) -> DataFrame:
    """A property's observations in order of time."""
    return rows.where(F.col("property_id") == property_id).orderBy("at", "signal_id", "item")


def source_mix(rows: DataFrame, by: str, kind: str) -> DataFrame:
    """Rows by kind with their share within ``by``."""
    n = rows.groupBy(by, kind).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(by)), 6))


def reliability_level(n: Column) -> Column:
    return F.when(n >= 10, 4).when(n >= 7, 3).when(n >= 5, 2).when(n > 0, 1).otherwise(0)


def age_bucket(at: Column, now: Column) -> Column:
    days = F.datediff(now, at)
    return F.when(days < 1, "today").when(days < 30, F.concat(days.cast("string"), F.lit("d"))).when(days < 365, F.concat(F.floor(days / 30).cast("string"), F.lit("mo"))).otherwise(F.concat(F.floor(days / 365).cast("string"), F.lit("y")))


def map_weight(rows: DataFrame, value: str) -> DataFrame:
    """Weight of each row between least and largest value; one half without a value or if all are equal."""
    ends = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    weight = F.when(F.col(value).isNull() | F.coalesce(span == 0, F.lit(True)), 0.5).otherwise((F.col(value) - F.col("_lo")) / span)
    return rows.join(F.broadcast(ends)).withColumn("weight", weight).drop("_lo", "_hi")


def search(rows: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows whose columns, joined and in lower case, hold the query."""
    return rows.where(F.lower(F.concat_ws(" ", *columns)).contains(query.lower()))


def tree_rollup(places: DataFrame, rows: DataFrame, place: str) -> DataFrame:
    """(id, name, n, median): statistics of each place over its own rows and those of all places below it, however deep."""
    reach = ancestors(places)
    own = rows.join(places.select(F.col("name").alias(place), F.col("id").alias("below")), place).select("below", "ppm2")
    above = own.join(reach, "below")
    counts = above.groupBy("id").agg(F.count("*").alias("n"))
    return counts.join(medians(above, ["id"], "ppm2").select("id", "median"), "id").join(places.select("id", "name"), "id")
