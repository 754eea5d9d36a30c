"""Queries on segments, trends, areas and design statistics."""

from pyspark.sql import functions as F

from pricetide.operators import market as M
from pricetide.operators import stats as S
from pricetide.operators.quantiles import distributions
from pricetide.operators.quantiles import quantiles as quantiles_of
from pricetide.plans.registry import query
from pricetide.sources.domain import OBS

MONTHS = 24
WINDOW = f"""{OBS},
base AS (SELECT * FROM reviewed WHERE seen_at >= (SELECT date_trunc('month', max(seen_at)) - INTERVAL {MONTHS - 1} MONTH FROM reviewed))"""
DIST = "count({0}) AS n, quantile_cont({0}, 0.5) AS median, quantile_cont({0}, 0.25) AS p25, quantile_cont({0}, 0.75) AS p75, min({0}) AS min, max({0}) AS max"


def base(d):
    return M.in_window(d.reviewed(), MONTHS)


@query("A4_segment_distribution", f"WITH {OBS} SELECT property_type, deal_status, {DIST.format('ppm2')}, count(ppm2) < 5 AS underpowered FROM reviewed WHERE ppm2 IS NOT NULL AND deal_status IN ('asking', 'transacted') GROUP BY ALL", "median p25 p75 min max")
def segment_distribution(d):
    return M.segments(d.reviewed())


@query("A1_quantiles_by_type", f"WITH {OBS} SELECT property_type, quantile_cont(ppm2, 0.1) AS p10, quantile_cont(ppm2, 0.9) AS p90, quantile_cont(ppm2, 0.99) AS p99 FROM obs GROUP BY property_type", "p10 p90 p99")
def quantiles(d):
    return quantiles_of(d.observations(), ["property_type"], F.col("ppm2"), {"p10": 0.1, "p90": 0.9, "p99": 0.99}).select("property_type", "p10", "p90", "p99")


@query("A2_distribution_by_area", f"WITH {OBS} SELECT area, {DIST.format('ppm2')} FROM reviewed GROUP BY area", "median p25 p75 min max")
def distribution_by_area(d):
    return distributions(d.reviewed(), ["area"], "ppm2")


@query("A3_sample_guard", f"WITH {OBS} SELECT property_id, deal_status, count(*) AS n, count(*) < 5 AS underpowered FROM reviewed GROUP BY property_id, deal_status")
def sample_guard(d):
    return d.reviewed().groupBy("property_id", "deal_status").agg(F.count("*").alias("n")).withColumn("underpowered", S.underpowered())


TREND = f"""{WINDOW},
axis AS (SELECT unnest(generate_series((SELECT date_trunc('month', max(seen_at)) - INTERVAL {MONTHS - 1} MONTH FROM base)::TIMESTAMP, (SELECT date_trunc('month', max(seen_at)) FROM base)::TIMESTAMP, INTERVAL 1 MONTH)) AS month),
m AS (SELECT date_trunc('month', seen_at)::TIMESTAMP AS month, quantile_cont(ppm2, 0.5) FILTER (WHERE deal_status = 'asking') AS asking, quantile_cont(ppm2, 0.5) FILTER (WHERE deal_status = 'transacted') AS transacted, count(*) AS volume FROM base GROUP BY 1),
trend AS (SELECT strftime(month, '%Y-%m') AS key, 'T' || month(month) AS label, asking, transacted, coalesce(volume, 0) AS volume FROM axis LEFT JOIN m USING (month))"""


@query("A5_A6_F10_monthly_trend", f"WITH {TREND} SELECT * FROM trend", "asking transacted")
def trend(d):
    return M.monthly_trend(base(d), MONTHS)


@query("A12_P33_trend_change", f"""WITH {TREND}, e AS (SELECT arg_min(asking, key) AS first, arg_max(asking, key) AS latest FROM trend WHERE asking IS NOT NULL)
SELECT first, latest, (latest - first) / first * 100 AS change_pct, CASE WHEN (latest - first) / first * 100 > 0.2 THEN 'up' WHEN (latest - first) / first * 100 < -0.2 THEN 'down' ELSE 'flat' END AS direction FROM e""", "first latest change_pct")  # fmt: skip
def trend_change(d):
    return M.trend_change(M.monthly_trend(base(d), MONTHS))


@query("A13_latest_median", f"WITH {TREND} SELECT arg_max(asking, key) AS headline, max(key) AS month FROM trend WHERE asking IS NOT NULL", "headline")
def latest_median(d):
    return M.monthly_trend(base(d), MONTHS).where("asking is not null").agg(F.max_by("asking", "key").alias("headline"), F.max("key").alias("month"))


@query("A7_P3_area_rank", f"WITH {WINDOW} SELECT area, quantile_cont(ppm2, 0.5) AS median, count(*) AS n, count(*) < 5 AS dim FROM base WHERE ppm2 IS NOT NULL AND area <> '' GROUP BY area", "median")
def area_rank(d):
    return M.rank_areas(base(d)).orderBy(F.desc("median"), "area")


HISTOGRAM = f"""{OBS},
b AS (SELECT min(ppm2) AS low, max(ppm2) AS hi, greatest(round((max(ppm2) - min(ppm2)) / 7 / 1000.0) * 1000.0, 1000.0) AS step FROM reviewed HAVING count(*) >= 5 AND max(ppm2) > min(ppm2)),
c AS (SELECT floor(low / step) * step AS lo, step, greatest(1, ceil((hi - floor(low / step) * step) / step))::INTEGER AS bins FROM b),
h AS (SELECT least(floor((ppm2 - lo) / step), bins - 1)::INTEGER AS bin, count(*) AS n FROM reviewed, c GROUP BY 1),
bins AS (SELECT x.bin, lo, step, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, bins))::INTEGER AS bin, lo, step FROM c) x LEFT JOIN h USING (bin))"""


@query("A8_F31_histogram", f"WITH {HISTOGRAM} SELECT * FROM bins")
def histogram(d):
    return S.histogram(d.reviewed(), "ppm2", 7, 1000.0)


@query("A9_median_bin", f"WITH {HISTOGRAM}, r AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS reached, sum(n) OVER () AS total FROM bins) SELECT min(bin) FILTER (WHERE reached >= total / 2) AS median_bin FROM r")
def median_bin(d):
    return S.median_bin(S.histogram(d.reviewed(), "ppm2", 7, 1000.0))


DISCOUNT = """(quantile_cont(ppm2, 0.5) FILTER (WHERE deal_status = 'asking') - quantile_cont(ppm2, 0.5) FILTER (WHERE deal_status = 'transacted')) / quantile_cont(ppm2, 0.5) FILTER (WHERE deal_status = 'asking') * 100"""


@query("A10_discount", f"WITH {OBS} SELECT property_type, area, {DISCOUNT} AS discount_pct FROM reviewed GROUP BY property_type, area", "discount_pct")
def discount(d):
    return M.discounts(d.reviewed(), "property_type", "area")


@query("A11_mean_discount", f"WITH {OBS}, t AS (SELECT property_type, {DISCOUNT} AS discount_pct FROM reviewed GROUP BY 1) SELECT round(avg(discount_pct), 6) AS mean_discount_pct, count(discount_pct) AS types FROM t")
def mean_discount(d):
    return M.mean_discount(d.reviewed()).withColumn("mean_discount_pct", F.round("mean_discount_pct", 6))


@query("A14_facet_counts", f"WITH {OBS} SELECT property_type, count(*) AS n FROM reviewed GROUP BY property_type")
def facet_counts(d):
    return M.facets(d.reviewed(), "property_type").orderBy(F.desc("n"), "property_type")


@query("A15_facet_values", f"WITH {OBS} SELECT DISTINCT project, property_type FROM reviewed")
def facet_values(d):
    return d.reviewed().select("project", "property_type").distinct().orderBy("project", "property_type")


@query("A16_totals", f"WITH {OBS}, s AS (SELECT property_type, deal_status, count(*) AS n FROM reviewed WHERE ppm2 IS NOT NULL AND deal_status IN ('asking', 'transacted') GROUP BY ALL) SELECT sum(n)::BIGINT AS priced, count(*) FILTER (WHERE n < 5) AS underpowered_segments, count(*) AS segments FROM s")
def totals(d):
    return M.totals(d.reviewed())


@query("A27_iqr_axis", f"""WITH {OBS}, s AS (SELECT property_type, deal_status, quantile_cont(ppm2, 0.25) AS p25, quantile_cont(ppm2, 0.75) AS p75 FROM reviewed GROUP BY ALL), e AS (SELECT property_type, min(p25) AS lo, max(p75) AS hi FROM s GROUP BY 1)
SELECT property_type, lo - (hi - lo) * 0.06::DOUBLE AS axis_min, (lo + hi) / 2 AS axis_mid, hi + (hi - lo) * 0.06::DOUBLE AS axis_max FROM e""", "axis_min axis_mid axis_max")  # fmt: skip
def iqr_axis(d):
    return M.iqr_axis(M.segments(d.reviewed()))


@query("A36_P16_P17_P18_overview", f"""WITH {WINDOW}, f AS (SELECT * FROM base WHERE property_type = 'ECONOMY' AND deal_status = 'asking')
SELECT 'segment' AS part, property_type || '/' || deal_status AS key, count(*) AS n, quantile_cont(ppm2, 0.5) AS value FROM f GROUP BY 2
UNION ALL SELECT 'area', area, count(*), quantile_cont(ppm2, 0.5) FROM f GROUP BY 2
UNION ALL SELECT 'month', strftime(seen_at, '%Y-%m'), count(*), quantile_cont(ppm2, 0.5) FROM f GROUP BY 2""", "value")  # fmt: skip
def overview(d):
    parts = M.overview(d.reviewed(), M.Filters.parse({"period": "24", "type": "ECONOMY", "deal": "asking"}))
    tag = lambda name: F.lit(name).alias("part")
    segment = parts["segments"].select(tag("segment"), F.concat_ws("/", "property_type", "deal_status").alias("key"), "n", F.col("median").alias("value"))
    area = parts["areas"].select(tag("area"), F.col("area").alias("key"), "n", F.col("median").alias("value"))
    month = parts["trend"].where("volume > 0").select(tag("month"), "key", F.col("volume").alias("n"), F.col("asking").alias("value"))
    return segment.unionByName(area).unionByName(month)


@query("D1_segment_grouping_sets", f"""WITH {OBS} SELECT listing_type, deal_status, property_type, {DIST.format('ppm2')}, grouping(listing_type, deal_status, property_type)::INTEGER AS level
FROM reviewed WHERE ppm2 IS NOT NULL AND deal_status IN ('asking', 'transacted') GROUP BY GROUPING SETS ((listing_type, deal_status, property_type), (listing_type, deal_status), (listing_type))""", "median p25 p75 min max")  # fmt: skip
def grouping_sets(d):
    return M.segment_sets(d.reviewed())


@query("D2_recency_weighted_median", f"""WITH {OBS}, a AS (SELECT property_type, deal_status, ppm2, 0.5::DOUBLE ** (date_diff('day', seen_at::DATE, (SELECT max(seen_at::DATE) FROM reviewed)) // 180) AS w FROM reviewed WHERE deal_status IN ('asking', 'transacted')),
r AS (SELECT *, sum(w) OVER (PARTITION BY property_type, deal_status ORDER BY ppm2 RANGE UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY property_type, deal_status) AS total FROM a)
SELECT property_type, deal_status, count(*) AS n, min(ppm2) FILTER (WHERE run >= total / 2) AS weighted_median FROM r GROUP BY 1, 2""", "weighted_median")  # fmt: skip
def recency(d):
    return M.recency_weighted(d.reviewed())


@query("D3_volatility", f"WITH {OBS} SELECT listing_type, deal_status, property_type, quantile_cont(ppm2, 0.75) - quantile_cont(ppm2, 0.25) AS iqr_width FROM reviewed WHERE deal_status IN ('asking', 'transacted') GROUP BY ALL", "iqr_width")
def volatility(d):
    return M.segments(d.reviewed(), ("listing_type", "deal_status", "property_type")).select("listing_type", "deal_status", "property_type", (F.col("p75") - F.col("p25")).alias("iqr_width"))


@query("D4_liquidity", f"WITH {OBS}, c AS (SELECT area, strftime(date_trunc('quarter', seen_at), '%Y-%m') AS quarter, count(*) AS n FROM reviewed GROUP BY ALL) SELECT area, quarter, n, round(n / sum(n) OVER (PARTITION BY quarter), 6) AS share FROM c")
def liquidity(d):
    return M.liquidity(d.reviewed())


@query("D5_valuation", f"""WITH {OBS}, b AS (SELECT project, property_type, quantile_cont(ppm2, 0.5) AS baseline FROM reviewed GROUP BY ALL), o AS (SELECT property_id, project, property_type, quantile_cont(ppm2, 0.5) AS median, count(*) AS n FROM reviewed GROUP BY ALL)
SELECT property_id, n, median, baseline, round(median / baseline, 6) AS ratio, CASE WHEN median / baseline > 1.1 THEN 'over' WHEN median / baseline < 0.9 THEN 'under' ELSE 'fair' END AS verdict FROM o JOIN b USING (project, property_type)""", "median baseline")  # fmt: skip
def valuation(d):
    return M.valuation(d.reviewed())


@query("D6_bands_with_outliers", f"""WITH {OBS}, q AS (SELECT *, strftime(date_trunc('quarter', seen_at), '%Y-%m') AS quarter FROM reviewed), b AS (SELECT quarter, property_type, {DIST.format('ppm2')} FROM q GROUP BY ALL)
SELECT quarter, property_type, b.n, b.p25, b.median, b.p75, count(*) FILTER (WHERE ppm2 < p25 - 1.5::DOUBLE * (p75 - p25) OR ppm2 > p75 + 1.5::DOUBLE * (p75 - p25)) AS outliers FROM q JOIN b USING (quarter, property_type) GROUP BY ALL""", "p25 median p75")  # fmt: skip
def bands(d):
    return M.outlier_bands(d.reviewed())


@query("D11_source_reliability", f"""WITH {OBS}, m AS (SELECT listing_type, deal_status, property_type, quantile_cont(ppm2, 0.5) AS mid FROM reviewed GROUP BY ALL),
o AS (SELECT r.*, abs(ppm2 - mid) AS off FROM reviewed r JOIN m USING (listing_type, deal_status, property_type)), a AS (SELECT listing_type, deal_status, property_type, quantile_cont(off, 0.5) AS mad FROM o GROUP BY ALL)
SELECT source_id, count(*) AS n, quantile_cont(off / mad, 0.5) AS median_z, count(*) FILTER (WHERE off / mad > 3) AS bait FROM o JOIN a USING (listing_type, deal_status, property_type) GROUP BY source_id""", "median_z")  # fmt: skip
def reliability(d):
    return M.source_reliability(d.reviewed())


@query("A21_A22_filtered_aggregates", f"""WITH {OBS} SELECT property_id, quantile_cont(ppm2, 0.5) FILTER (WHERE listing_type = 'sale' AND NOT needs_review) AS median_ppm2, count(*) FILTER (WHERE ppm2 IS NOT NULL) AS n FROM obs GROUP BY property_id""", "median_ppm2")
def filtered(d):
    d.observations().createOrReplaceTempView("pricetide_obs")
    return d.spark.sql("SELECT property_id, percentile_cont(0.5) WITHIN GROUP (ORDER BY ppm2) FILTER (WHERE listing_type = 'sale' AND NOT needs_review) AS median_ppm2, count(*) FILTER (WHERE ppm2 IS NOT NULL) AS n FROM pricetide_obs GROUP BY property_id")


@query("A24_queue_count", f"WITH {OBS} SELECT count(*) AS pending FROM obs WHERE needs_review")
def queue_count(d):
    return d.observations().where("needs_review").agg(F.count("*").alias("pending"))


@query("P2_F9_P32_normalized_observations", f"""WITH {OBS}, m AS (SELECT max(seen_at) AS now FROM obs)
SELECT signal_id, item, property_id, source_id, coalesce(project, name) AS project, coalesce(property_type, 'unknown') AS type, strftime(seen_at, '%Y-%m') AS month,
CASE WHEN date_diff('day', seen_at::DATE, now::DATE) < 1 THEN 'today' WHEN date_diff('day', seen_at::DATE, now::DATE) < 30 THEN date_diff('day', seen_at::DATE, now::DATE) || 'd' WHEN date_diff('day', seen_at::DATE, now::DATE) < 365 THEN date_diff('day', seen_at::DATE, now::DATE) // 30 || 'mo' ELSE date_diff('day', seen_at::DATE, now::DATE) // 365 || 'y' END AS age
FROM obs, m WHERE NOT needs_review""")  # fmt: skip
def normalized(d):
    from pricetide.operators.entities import age_bucket

    rows = d.observations()
    now = rows.agg(F.max("at").alias("now"))
    age = age_bucket(F.to_date("at"), F.to_date("now"))
    return rows.where("not needs_review").join(F.broadcast(now)).select("signal_id", "item", "property_id", "source_id", F.coalesce("project", "name").alias("project"), F.coalesce("property_type", F.lit("unknown")).alias("type"), F.date_format("at", "yyyy-MM").alias("month"), age.alias("age"))
