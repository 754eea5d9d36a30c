"""Robust statistics as aggregate expressions and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.operators.quantiles import finite

MIN_SAMPLE = 5
MEDIAN_BUCKETS = 64  # of values to a factor of e


def quantile(x: Column, q: float) -> Column:
    """Quantile with linear interpolation, null of nothing, of groups whose values fit a buffer; ``quantiles`` has no such bound."""
    return F.percentile(x, q)


def distribution(x: Column, prefix: str = "") -> list[Column]:
    """n, median, p25, p75, min and max over finite values of groups that fit a buffer."""
    v = finite(x)
    found = {"n": F.count(v), "median": quantile(v, 0.5), "p25": quantile(v, 0.25), "p75": quantile(v, 0.75), "min": F.min(v), "max": F.max(v)}
    return [c.alias(prefix + k) for k, c in found.items()]


def underpowered(n: str = "n") -> Column:
    return F.col(n) < MIN_SAMPLE


def histogram(rows: DataFrame, value: str, bins: int = 7, unit: float = 1e6) -> DataFrame:
    """(bin, lo, step, n) with empty bins; no rows for fewer than MIN_SAMPLE values or equal ones.

    The step is a multiple of ``unit``; the last bin is closed. One row of bounds is joined to the values.
    """
    clean = rows.select(finite(F.col(value)).alias("v")).where("v is not null")
    raw = F.round((F.col("hi") - F.col("low")) / bins / unit) * unit
    bounds = clean.agg(F.count("*").alias("all"), F.min("v").alias("low"), F.max("v").alias("hi")).where((F.col("all") >= MIN_SAMPLE) & (F.col("hi") > F.col("low")))
    bounds = bounds.withColumn("step", F.greatest(raw, F.lit(float(unit)))).withColumn("lo", F.floor(F.col("low") / F.col("step")) * F.col("step"))
    bounds = bounds.withColumn("bins", F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / F.col("step"))).cast("int")).select("step", "lo", "bins")
    placed = clean.join(F.broadcast(bounds)).withColumn("bin", F.least(F.floor((F.col("v") - F.col("lo")) / F.col("step")), F.col("bins") - 1).cast("int"))
    counted = placed.groupBy("bin").agg(F.count("*").alias("n"))
    axis = bounds.select("lo", "step", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return axis.join(counted, "bin", "left").select("bin", "lo", "step", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def median_bin(bins: DataFrame) -> DataFrame:
    """The first bin that reaches half of all values."""
    so_far = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy())
    marked = bins.withColumn("reached", so_far).withColumn("total", total)
    return marked.agg(F.min(F.when(F.col("reached") >= F.col("total") / 2, F.col("bin"))).alias("median_bin"))


def month_axis(rows: DataFrame, at: str, months: int) -> DataFrame:
    """(key, month, label) of the last months up to that of the latest ``at``, oldest first."""
    last = rows.agg(F.max(F.trunc(at, "MM")).alias("last")).where("last is not null")
    month = F.explode(F.sequence(F.add_months("last", -(months - 1)), F.col("last"), F.expr("interval 1 month"))).alias("month")
    return last.select(month).select("month", F.date_format("month", "yyyy-MM").alias("key"), F.concat(F.lit("T"), F.month("month")).alias("label"))


def weighted_median(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """by, n, weighted_median: the least value at which the running weight reaches half of its group's.

    Weights are summed by bucket of value first (some thousands to a group, partial sums before the shuffle); only the
    rows of the bucket that reaches the half are put in order.
    """
    v = F.col(value)
    cells = rows.withColumn("_bucket", (F.signum(v) * F.floor(F.log1p(F.abs(v)) * MEDIAN_BUCKETS)).cast("bigint"))
    sums = cells.groupBy(*by, "_bucket").agg(F.sum(weight).alias("_w"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*by)
    upto = F.sum("_w").over(whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    marked = sums.withColumns({"_upto": upto, "_all": F.sum("_w").over(whole), "n": F.sum("_n").over(whole)}).where(F.col("_upto") >= F.col("_all") / 2)
    half = marked.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.min_by(F.struct(F.col("_bucket").alias("at"), (F.col("_upto") - F.col("_w")).alias("before"), F.col("_all").alias("all"), "n"), "_bucket").alias("_half"))
    same = F.col("_bucket") == F.col("_half.at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inner = cells.join(half, same).groupBy(*by, value, "_half").agg(F.sum(weight).alias(weight))  # equal values are one row
    run = F.col("_half.before") + F.sum(weight).over(whole.orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    reached = F.min(F.when(F.col("_run") >= F.col("_half.all") / 2, v))
    return inner.withColumn("_run", run).groupBy(*by).agg(F.first("_half.n").alias("n"), F.coalesce(reached, F.max(v)).alias("weighted_median"))
