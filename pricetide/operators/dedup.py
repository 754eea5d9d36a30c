"""Keep-first and keep-last rules, batches, inserts and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.text import normalize_name
from pricetide.session import cut


def first_by(rows: DataFrame, keys: list[str], *order: Column | str, k: int = 1) -> DataFrame:
    """The first k rows of each key in the order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def keep_first_names(rows: DataFrame, by: str, name: str, order: str) -> DataFrame:
    """(by, names): ``unique_text`` of a group's names in the order, by a group for each normalized name; one array holds distinct names alone."""
    value = F.trim(name)
    once = rows.select(by, value.alias("_v"), normalize_name(value).alias("_k"), order).groupBy(by, "_k").agg(F.min(order).alias("_o"), F.min_by("_v", order).alias("_v"))
    kept = F.when((F.col("_k") != "") & (F.col("_v") != ""), F.struct("_o", "_v"))  # groups without a name stay
    return once.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(kept)), lambda s: s["_v"]).alias("names"))


def new_only(incoming: DataFrame, known: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """Insert if absent: one row of each key that the known table doesn't hold; null keys match null."""
    left, right = first_by(incoming, keys, *order).alias("i"), known.select(*keys).distinct().alias("k")
    on = [F.col(f"i.{c}").eqNullSafe(F.col(f"k.{c}")) for c in keys]
    return left.join(right, on, "left_anti")


def upsert(known: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The last version of each key, incoming rows before known ones of the same version."""
    both = known.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return first_by(both, keys, F.desc(version), F.desc("_new")).drop("_new")


def numbered(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    """rows with ``place``, from 0 in the order within their group, whatever its size.

    Rows are partitioned by range of group and order, so a large group is spread; the counts of its partitions tell where
    each begins, and a window numbers the rows within one.
    """
    ranged = cut(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
    first = counts.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_part").alias("_in"), (upto - F.col("_n")).alias("_first"))
    inner = ranged.withColumn("_inner", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)))
    same = F.col("_part") == F.col("_in")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return inner.join(first, same).withColumn("place", F.col("_first") + F.col("_inner") - 1).drop("_part", "_in", "_first", "_inner", *(f"_{c}" for c in by))


def batches(rows: DataFrame, by: str, size: int, *order: str) -> DataFrame:
    """Batch number of each row within ``by``, ``size`` rows each, in the order."""
    return numbered(rows, [by], *order).withColumn("batch", F.floor(F.col("place") / size).cast("int")).drop("place")


def merge_text(kept: Column, new: Column, keep_key) -> Column:
    """Union of two text arrays, keeping the first of each key."""
    none = F.array().cast("array<string>")
    return keep_key(F.concat(F.coalesce(kept, none), F.coalesce(new, none)))


def merge_note(old: Column, new: Column, prefix: str) -> Column:
    """The old note with the prefixed new one below it, unless it holds it already."""
    line = F.concat(F.lit(prefix), F.trim(new))
    blank = F.coalesce(F.trim(old), F.lit(""))
    return F.when(F.coalesce(F.trim(new), F.lit("")) == "", old).when(blank == "", line).when(blank.contains(line), old).otherwise(F.concat(blank, F.lit("\n\n"), line))


def merges_as_of(log: DataFrame, when: Column) -> DataFrame:
    """The merge log (merge_id, from_id, to_id, created_at, undone_at) as it stood at a time, with ``undone``."""
    undone = F.coalesce(F.col("undone_at") <= when, F.lit(False))
    return log.where(F.col("created_at") <= when).select("merge_id", "from_id", "to_id", undone.alias("undone"))


def resolve_pointers(log: DataFrame) -> DataFrame:
    """(id, canonical) from a merge log (merge_id, from_id, to_id, undone): undone merges don't count, the last merge of
    an id does, and chains of any length are followed by doubling until none is left. A cycle is an error.

    Ids that have arrived are put aside. Without a cycle a chain is at most as long as there are merges, so more rounds than
    their logarithm mean one.
    """
    moving = cut(first_by(log.where("not undone"), ["from_id"], F.desc("merge_id")).select(F.col("from_id").alias("id"), F.col("to_id").alias("canonical")))
    rounds, arrived = moving.count().bit_length() + 1, moving.where("false")
    for _ in range(rounds):
        step = arrived.unionByName(moving).select(F.col("id").alias("_id"), F.col("canonical").alias("_next"))
        after = cut(moving.join(step, F.col("canonical") == F.col("_id"), "left").select("id", F.coalesce("_next", "canonical").alias("canonical"), F.col("_next").isNotNull().alias("moved")))
        arrived = arrived.unionByName(after.where("not moved").drop("moved"))
        moving = after.where("moved").drop("moved")
        if moving.isEmpty():
            return arrived
    raise ValueError(f"the merge log has a cycle that leads from {[r['id'] for r in moving.orderBy('id').limit(5).collect()]} back to ids on the way")


def followed(rows: DataFrame, pointers: DataFrame, key: str, small: int = 200_000) -> DataFrame:
    """rows with ``key`` replaced by what it was merged into; pointers (id, canonical) go beside the rows if they are few."""
    to = pointers.select(F.col("id").alias("_id"), F.col("canonical").alias("_canonical"))
    to = F.broadcast(to) if pointers.count() <= small else to
    return rows.join(to, F.col(key) == F.col("_id"), "left").withColumn(key, F.coalesce("_canonical", key)).drop("_id", "_canonical")
