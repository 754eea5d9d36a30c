"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetide.session import discard, stash_path

HOT_DEGREE = 4096  # nodes of more edges, and more than a thousandth of all, aren't windowed: at most 2000 of them


def _with_least(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """rows (u, v) with ``least``, the least v of each u. The rows of a hot u stay where they are."""
    windowed = F.min("v").over(Window.partitionBy("u"))
    if hot is None:
        return rows.withColumn("least", windowed)
    own = rows.join(F.broadcast(hot), "u")
    low = own.groupBy("u").agg(F.min("v").alias("least"))
    return own.join(F.broadcast(low), "u").unionByName(rows.join(F.broadcast(hot), "u", "left_anti").withColumn("least", windowed))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node that has an edge; root is the least node of its component.

    Every round points all neighbours above a node, and then all below it, at the least of them. Rounds end when
    the edges stay the same. Edges stay at most as many as at the start; a round's table is removed once the next is
    written. Nodes of very many edges get their least neighbour from partial minima and a broadcast of as many rows as
    there are such nodes. Loops, null ends, repeated edges and an empty table are allowed.
    """
    spark = edges.sparkSession

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        path = stash_path(spark, "edges")
        df.write.parquet(path)
        return spark.read.schema("u bigint, v bigint").parquet(path), path

    ends = edges.select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    (now, path), mark = written(ends.distinct()), None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == mark or not found[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = found
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        many = both.groupBy("u").count().where(F.col("count") > max(HOT_DEGREE, found[0] // 1000)).collect()  # at most 2000 rows
        hot = spark.createDataFrame([(r["u"],) for r in many], "u bigint") if many else None
        large = _with_least(both, hot).where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()
        between = None
        if hot is not None:  # it is read more than once
            large, between = written(large)
        star = F.explode(F.array(F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v"))))
        new = written(_with_least(large, hot).select(star.alias("e")).select("e.*").where("u != v").distinct())
        for old in (path, between):
            if old:
                discard(spark, old)
        now, path = new
