"""Segmented market statistics over observation rows (ppm2, listing_type, deal_status, property_type, project, area, at)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetide.operators import stats as S
from pricetide.operators.quantiles import distributions, medians, quantiles
from pricetide.session import stash

DEALS = ("asking", "transacted")


@dataclass(frozen=True)
class Filters:
    """Checked filters of a market view; ``all`` stands for no filter."""

    months: int = 12
    property_type: str = "all"
    project: str = "all"
    deal: str = "all"

    @classmethod
    def parse(cls, given: dict) -> Filters:
        """From loose parameters; what isn't valid takes its default."""
        months = str(given.get("period", ""))
        deal = given.get("deal")
        return cls(int(months) if months in ("6", "12", "24") else 12, given.get("type") or "all", given.get("project") or "all", deal if deal in DEALS else "all")


def in_window(rows: DataFrame, months: int, at: str = "at") -> DataFrame:
    """Rows from the first day of the first month of the axis on, counted from the latest row.

    The latest month is read first, so that the bound is a literal, which reaches the scan.
    """
    last = rows.agg(F.max(F.trunc(at, "MM"))).first()[0]
    return rows.where("false") if last is None else rows.where(F.col(at) >= F.add_months(F.lit(last), -(months - 1)).cast("timestamp"))


def filtered(rows: DataFrame, f: Filters) -> DataFrame:
    for column, value in (("property_type", f.property_type), ("project", f.project), ("deal_status", f.deal)):
        if value != "all":
            rows = rows.where(F.col(column) == value)
    return rows


def segments(rows: DataFrame, by: tuple[str, ...] = ("property_type", "deal_status")) -> DataFrame:
    """Distribution of ppm2 by segment, with the sample guard."""
    priced = rows.where(F.col("ppm2").isNotNull() & F.col("deal_status").isin(*DEALS))
    return distributions(priced, list(by), "ppm2").withColumn("underpowered", S.underpowered())


def segment_sets(rows: DataFrame) -> DataFrame:
    """The full segment key and its roll-ups to (listing type, deal) and listing type, in one pass over rows unfolded by level.

    ``level`` has a bit for each key that is rolled up, the last key's lowest.
    """
    priced = rows.where(F.col("ppm2").isNotNull() & F.col("deal_status").isin(*DEALS))
    keys = ["listing_type", "deal_status", "property_type"]
    shown = lambda k, level: F.when(level < (1 << (len(keys) - 1 - keys.index(k))), F.col(k))
    unfolded = priced.select("ppm2", *keys, F.explode(F.array(F.lit(0), F.lit(1), F.lit(3))).alias("level"))
    return distributions(unfolded.select("ppm2", "level", *(shown(k, F.col("level")).alias(k) for k in keys)), [*keys, "level"], "ppm2")


def _by_deal(found: DataFrame, by: list[str]) -> DataFrame:
    """by, asking and transacted: the medians of both deals side by side."""
    one = lambda d: F.max(F.when(F.col("deal_status") == d, F.col("median"))).alias(d)
    return found.groupBy(*by).agg(*map(one, DEALS))


def monthly_trend(rows: DataFrame, months: int) -> DataFrame:
    """key, label, asking, transacted, volume for each month of the axis, with and without data."""
    dated = rows.select(F.trunc("at", "MM").alias("month"), "deal_status", "ppm2")
    volume = dated.groupBy("month").agg(F.count("*").alias("volume"))
    mid = _by_deal(medians(dated.where(F.col("deal_status").isin(*DEALS)), ["month", "deal_status"], "ppm2"), ["month"])
    axis = F.broadcast(S.month_axis(rows, "at", months))
    found = volume.join(mid, "month", "left")
    return axis.join(found, "month", "left").select("key", "label", "asking", "transacted", F.coalesce("volume", F.lit(0)).cast("bigint").alias("volume"))


def trend_change(trend: DataFrame) -> DataFrame:
    """First and last non-null monthly asking medians, and the change between them in percent."""
    known = trend.where("asking is not null")
    ends = known.agg(F.min_by("asking", "key").alias("first"), F.max_by("asking", "key").alias("latest"))
    change = F.when(F.col("first") != 0, (F.col("latest") - F.col("first")) / F.col("first") * 100)
    direction = F.when(change > 0.2, "up").when(change < -0.2, "down").otherwise("flat")
    return ends.select("first", "latest", change.alias("change_pct"), direction.alias("direction"))


def rank_areas(rows: DataFrame) -> DataFrame:
    priced = rows.where("ppm2 is not null and area is not null and area <> ''")
    return medians(priced, ["area"], "ppm2").withColumn("dim", S.underpowered())


def discounts(rows: DataFrame, *by: str) -> DataFrame:
    """Percent by which the median transacted price is below the median asking one; null if either is missing."""
    both = _by_deal(medians(rows, [*by, "deal_status"], "ppm2"), list(by))
    return both.select(*by, F.when(F.col("asking") != 0, (F.col("asking") - F.col("transacted")) / F.col("asking") * 100).alias("discount_pct"))


def mean_discount(rows: DataFrame) -> DataFrame:
    """Mean of the property types' discounts."""
    return discounts(rows, "property_type").agg(F.avg("discount_pct").alias("mean_discount_pct"), F.count("discount_pct").alias("types"))


def facets(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def totals(rows: DataFrame) -> DataFrame:
    """Priced observations, and segments below the sample guard."""
    return segments(rows).agg(F.sum("n").alias("priced"), F.count(F.when(F.col("underpowered"), 1)).alias("underpowered_segments"), F.count("*").alias("segments"))


def iqr_axis(found: DataFrame) -> DataFrame:
    """Axis of each property type over its segments' quartiles: ends with 6 % of padding and the middle."""
    pad = (F.col("hi") - F.col("lo")) * 0.06
    ends = found.groupBy("property_type").agg(F.min("p25").alias("lo"), F.max("p75").alias("hi"))
    return ends.select("property_type", (F.col("lo") - pad).alias("axis_min"), ((F.col("lo") + F.col("hi")) / 2).alias("axis_mid"), (F.col("hi") + pad).alias("axis_max"))


def overview(rows: DataFrame, f: Filters) -> dict[str, DataFrame]:
    """The frames of an overview page over one base."""
    base = filtered(in_window(rows, f.months), f)
    return {
        "segments": segments(base),
        "trend": monthly_trend(base, f.months),
        "areas": rank_areas(base),
        "histogram": S.histogram(base, "ppm2"),
        "discount": mean_discount(base),
        "types": facets(base, "property_type"),
        "totals": totals(base),
    }


def recency_weighted(rows: DataFrame, half_life_days: int = 180) -> DataFrame:
    """Current estimate of each segment: median weighted by age, halved every half-life before the latest row."""
    priced = rows.where(F.col("ppm2").isNotNull() & F.col("deal_status").isin(*DEALS)).select("property_type", "deal_status", "ppm2", F.to_date("at").alias("day"))
    last = priced.agg(F.max("day").alias("last"))
    aged = priced.join(F.broadcast(last)).withColumn("weight", F.pow(F.lit(0.5), F.floor(F.datediff("last", "day") / half_life_days)))
    return S.weighted_median(aged, ["property_type", "deal_status"], "ppm2", "weight")


def liquidity(rows: DataFrame) -> DataFrame:
    """Observations by area and quarter, and their share of the quarter."""
    counted = rows.groupBy("area", F.date_format(F.date_trunc("quarter", "at"), "yyyy-MM").alias("quarter")).agg(F.count("*").alias("n"))
    share = F.round(F.col("n") / F.sum("n").over(Window.partitionBy("quarter")), 6)
    return counted.withColumn("share", share)


def valuation(rows: DataFrame) -> DataFrame:
    """Each property's median against that of its project and type: ratio and verdict beyond 10 %."""
    priced = rows.where("ppm2 is not null")
    base = medians(priced, ["project", "property_type"], "ppm2", "baseline").drop("n")
    own = medians(priced, ["property_id", "project", "property_type"], "ppm2")
    ratio = F.col("median") / F.col("baseline")
    verdict = F.when(ratio > 1.1, "over").when(ratio < 0.9, "under").otherwise("fair")
    return own.join(base, ["project", "property_type"]).select("property_id", "n", "median", "baseline", F.round(ratio, 6).alias("ratio"), verdict.alias("verdict"))


def outlier_bands(rows: DataFrame) -> DataFrame:
    """Quartiles by quarter and type, with the number of values beyond 1.5 quartile ranges."""
    priced = rows.where("ppm2 is not null").withColumn("quarter", F.date_format(F.date_trunc("quarter", "at"), "yyyy-MM"))
    keys = ["quarter", "property_type"]
    bands = distributions(priced, keys, "ppm2").withColumn("reach", 1.5 * (F.col("p75") - F.col("p25")))
    beyond = (F.col("ppm2") < F.col("p25") - F.col("reach")) | (F.col("ppm2") > F.col("p75") + F.col("reach"))
    out = priced.select(*keys, "ppm2").join(bands, keys).groupBy(*keys).agg(F.count(F.when(beyond, 1)).alias("outliers"))
    return bands.join(out, keys).select(*keys, "n", "p25", "median", "p75", "outliers")


def source_reliability(rows: DataFrame) -> DataFrame:
    """Each source's median deviation from its segments' medians, in units of the segment's own (MAD), and far-off rows."""
    keys = ["listing_type", "deal_status", "property_type"]
    priced = stash(rows.where("ppm2 is not null").select(*keys, "source_id", "ppm2"), "priced")  # read in each of the passes
    middle = medians(priced, keys, "ppm2", "mid").drop("n")
    off = priced.join(middle, keys).withColumn("off", F.abs(F.col("ppm2") - F.col("mid")))
    mad = medians(off, keys, "off", "mad").drop("n")
    scored = off.join(mad, keys).withColumn("z", F.when(F.col("mad") > 0, F.col("off") / F.col("mad")))
    counts = scored.groupBy("source_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("z") > 3, 1)).alias("bait"))
    return counts.join(quantiles(scored, ["source_id"], F.col("z"), {"median_z": 0.5}).select("source_id", "median_z"), "source_id")
