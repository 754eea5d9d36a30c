"""Exact quantiles of groups of any size, by selection in passes.

Groups of few values are left to the built-in percentile, whose buffer then stays small. For the others no task ever holds
a group: a pass counts values by cell (partial sums before the shuffle), a window over a group's cells finds those that hold
the wanted ranks, and only the values of these cells go on to the next, finer pass. The first cells are by logarithm, later
ones split a cell evenly between its least and its largest value. A cell that holds one value ends the search, and one of few
values is put in order. Values of the wanted cells are written once, after the first pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.session import cut

SMALL = 100_000  # values of a group that the percentile's buffer may hold
CELLS = 4096  # of a split
PER_E = 64  # first cells to a factor of e
LISTED = 4096  # values that are put in order together
BROADCAST_CELLS, SALTS = 50_000, 64  # wanted cells beside the values; beyond, they are joined by group and salt

G = "_group"


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def beside(rows: DataFrame, table: DataFrame, on: Column, spread: Column) -> DataFrame:
    """rows joined to a table of cells with ``on``: by broadcast if it is small, else by group and salt, so that no group is one task."""
    if table.count() <= BROADCAST_CELLS:
        return rows.join(F.broadcast(table), on)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_own_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, on & (F.col("_own_salt") == F.col("_salt"))).drop("_own_salt", "_salt")


def _hits(ranks: DataFrame, cells: DataFrame) -> DataFrame:
    """(group, rank, before, n, lo, hi): the cell of each wanted rank; cells have group, from, cell, n, lo, hi and base, the values below them all."""
    upto = F.sum("n").over(Window.partitionBy(G, "from").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    placed = cells.withColumn("before", F.col("base") + upto - F.col("n")).drop("cell", "from", "base")
    wanted = ranks.withColumnRenamed(G, "_own")
    return wanted.join(placed, (F.col(G) == F.col("_own")) & (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))).drop("_own")


def selected(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """(group, rank, v): the value of each rank (from 0) of ranks (group, rank) in its group's order; rows are (group, v), without nulls."""
    v = F.col("v")
    counts = [F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    groups = ranks.select(F.col(G).alias("_own")).distinct()
    size = F.floor(F.ln(F.abs(v)) * PER_E) + 800 * PER_E  # above 0: the logarithm of the least double is -745
    first = F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("bigint")
    cells = beside(rows, groups, F.col(G) == F.col("_own"), v).groupBy(G, first.alias("cell")).agg(*counts)
    hits = cut(_hits(ranks, cells.withColumns({"from": F.lit(0.0), "base": F.lit(0).cast("bigint")})))
    found = []
    while True:
        found.append(hits.where("lo = hi").select(G, "rank", F.col("lo").alias("v")))
        left = hits.where("lo < hi")
        wanted = left.select(F.col(G).alias("_own"), F.col("lo").alias("from"), "hi", F.col("before").alias("base"), F.col("n").alias("held")).distinct()
        if wanted.isEmpty():
            break
        inside = (F.col(G) == F.col("_own")) & (v >= F.col("from")) & (v <= F.col("hi"))
        rows = cut(beside(rows.select(G, "v"), wanted, inside, v).drop("_own"))
        lists = rows.where(F.col("held") <= LISTED).groupBy(G, "from").agg(F.sort_array(F.collect_list("v")).alias("list"))  # LISTED values at most
        short = left.where(F.col("n") <= LISTED).select(G, "rank", F.col("lo").alias("from"), "before").join(lists, [G, "from"])
        found.append(cut(short.select(G, "rank", F.get("list", (F.col("rank") - F.col("before")).cast("int")).alias("v"))))
        rows = rows.where(F.col("held") > LISTED)
        step = F.floor((v - F.col("from")) / (F.col("hi") - F.col("from")) * CELLS).cast("bigint")
        cells = rows.select(G, "from", "base", "v", step.alias("cell")).groupBy(G, "from", "base", "cell").agg(*counts)
        hits = cut(_hits(left.where(F.col("n") > LISTED).select(G, "rank"), cells))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def quantiles(rows: DataFrame, by: list[str], value: Column, wanted: dict[str, float]) -> DataFrame:
    """by, n, min, max and a column for each of ``wanted`` (name: share), over the finite values of each group.

    Between two ranks the value is interpolated; a group without values has nulls. Null keys are a group like others.
    """
    held = rows.select(*by, finite(value.cast("double")).alias("_v"))
    counts = held.groupBy(*by).agg(F.count("_v").alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    large = cut(counts.where(F.col("n") > SMALL).select(F.struct(*by, F.lit(0).alias("_")).alias(G), "n", "min", "max"))
    aggregates = [F.count("_v").alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"), *(F.percentile("_v", q).alias(name) for name, q in wanted.items())]
    if large.isEmpty():
        return held.groupBy(*by).agg(*aggregates)
    keyed = held.select(F.struct(*by, F.lit(0).alias("_")).alias(G), F.col("_v").alias("v"))
    at = {name: (F.col("n") - 1) * F.lit(float(q)) for name, q in wanted.items()}
    ends = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(h), F.ceil(h)) for h in at.values()))))
    values = selected(keyed.where("v IS NOT NULL"), large.select(G, F.explode(ends).alias("rank")))
    listed = values.groupBy(G).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))  # two a share
    joined = large.join(listed, G)

    def between(h: Column) -> Column:
        lo, hi = F.try_element_at("at", F.floor(h)), F.try_element_at("at", F.ceil(h))
        return F.when(F.floor(h) == F.ceil(h), lo).otherwise((F.ceil(h) - h) * lo + (h - F.floor(h)) * hi)

    names = ["n", "min", "max", *wanted]
    chosen = joined.select(*(F.col(G)[c].alias(c) for c in by), "n", "min", "max", *(between(h).alias(name) for name, h in at.items()))
    few = keyed.join(large.select(G), G, "left_anti") if large.count() > BROADCAST_CELLS else keyed.join(F.broadcast(large.select(G)), G, "left_anti")
    rest = few.withColumnRenamed("v", "_v").groupBy(G).agg(*aggregates).select(*(F.col(G)[c].alias(c) for c in by), *names)
    return rest.unionByName(chosen)


def distributions(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, median, p25, p75, min and max over the finite values of each group."""
    found = quantiles(rows, by, F.col(value), {"median": 0.5, "p25": 0.25, "p75": 0.75})
    return found.select(*by, "n", "median", "p25", "p75", "min", "max")


def medians(rows: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """by, the median and n, the number of finite values of each group."""
    return quantiles(rows, by, F.col(value), {name: 0.5}).select(*by, name, "n")
