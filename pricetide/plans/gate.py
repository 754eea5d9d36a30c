"""Queries on the quality gate, drafts and summaries."""

from pyspark.sql import functions as F

from pricetide.functions import gate as G
from pricetide.functions import text as T
from pricetide.operators import ingest as I
from pricetide.operators.extract import post_quality
from pricetide.plans.registry import query
from pricetide.sources.domain import EXTRACTIONS, extractions

IDENTITY = "(coalesce(project_name, '') <> '' OR coalesce(name, '') <> '' OR coalesce(location_text, '') <> '')"
REASON = f"""CASE WHEN confidence < 0.4 THEN 'confidence too low (' || printf('%.2f', confidence) || ' < 0.4)' WHEN NOT {IDENTITY} THEN 'lacks identity or location'
  WHEN listing_type = 'unknown' THEN 'unknown listing type (neither sale nor rent)' WHEN price_vnd IS NULL AND area_m2 IS NULL THEN 'lacks both price and area' WHEN price_vnd IS NULL AND listing_type = 'sale' THEN 'sale listing lacks price' END"""
REVIEW = f"(confidence < 0.6 OR NOT {IDENTITY} OR (type = 'apartment' AND coalesce(project_name, '') <> '' AND house_number IS NULL))"
COMPLETE = f"(price_vnd IS NOT NULL AND price_basis <> 'unknown' AND listing_type <> 'unknown' AND area_m2 IS NOT NULL AND {IDENTITY})"


@query("P11_P12_rejections", f"WITH {EXTRACTIONS} SELECT coalesce({REASON}, 'usable') AS reason, count(*) AS n FROM ext GROUP BY 1")
def rejections(d):
    return extractions(d).groupBy(F.coalesce(G.rejection_reason(), F.lit("usable")).alias("reason")).agg(F.count("*").alias("n"))


@query("P1_P7_P13_P14_gate_columns", f"""WITH {EXTRACTIONS} SELECT signal_id, item, ref, {IDENTITY} AS has_identity, {REVIEW} AS review,
CASE WHEN price_basis = 'per_m2' THEN price_vnd WHEN price_basis = 'total' AND area_m2 > 0 THEN round(price_vnd / area_m2) END::DOUBLE AS ppm2, coalesce(nullif(concat_ws(' / ', project_name, building_name, house_number), ''), name, location_text, '(unnamed)') AS label FROM ext""")  # fmt: skip
def gate_columns(d):
    label = T.identity_label("project_name", "building_name", "house_number", "name", "location_text")
    return extractions(d).select("signal_id", "item", "ref", G.has_identity().alias("has_identity"), G.should_review().alias("review"), G.price_per_m2().cast("double").alias("ppm2"), label.alias("label"))


@query("P8_P10_missing_fields", f"""WITH {EXTRACTIONS}, m AS (SELECT *, list_filter([CASE WHEN price_vnd IS NULL THEN 'price' END, CASE WHEN price_basis = 'unknown' THEN 'price basis (total or per m²)' END, CASE WHEN listing_type = 'unknown' THEN 'listing type (sale or rent)' END,
  CASE WHEN area_m2 IS NULL THEN 'area (m²)' END, CASE WHEN NOT {IDENTITY} THEN 'project/property identity or location' END], lambda x: x IS NOT NULL) AS missing FROM ext)
SELECT signal_id, item, ref, '#' || item + 1 || ' ' || coalesce(nullif(concat_ws(' / ', project_name, building_name, house_number), ''), name, location_text, '(unnamed)') || ': needs ' || array_to_string(missing, ', ') AS line FROM m WHERE len(missing) > 0""")  # fmt: skip
def missing(d):
    return extractions(d).select("signal_id", "item", "ref", G.incomplete_line(F.col("item")).alias("line")).where("line is not null")


@query("P9_A31_draft_progress", f"WITH {EXTRACTIONS} SELECT signal_id, count(*) AS total, count(*) FILTER (WHERE {COMPLETE}) AS complete, round(100 * count(*) FILTER (WHERE {COMPLETE}) / count(*))::INTEGER AS percent, count(*) FILTER (WHERE {COMPLETE}) = count(*) AS ready FROM ext GROUP BY 1")
def progress(d):
    return I.draft_progress(extractions(d), "signal_id")


@query("E7_V4_post_quality", f"""WITH {EXTRACTIONS}, r AS (SELECT signal_id, {REASON} AS reason FROM ext) SELECT signal_id, bool_or(reason IS NULL) AS accepted, CASE WHEN bool_or(reason IS NULL) THEN '' ELSE array_to_string(list_sort(list(DISTINCT reason)), '; ') END AS reasons FROM r GROUP BY 1""")
def quality(d):
    return post_quality(extractions(d), "signal_id").withColumn("reasons", F.array_join("reasons", "; "))


@query("F36_session_titles", f"WITH {EXTRACTIONS} SELECT signal_id, substr(coalesce(arg_min(project_name, item * 1000000 + ref) FILTER (WHERE project_name <> ''), arg_min(name, item * 1000000 + ref) FILTER (WHERE name <> ''), 'Untitled session'), 1, 80) AS title FROM ext GROUP BY 1")
def titles(d):
    return I.session_title(extractions(d).withColumn("place", F.col("item") * 1000000 + F.col("ref")), "signal_id", "place")


@query("V2_V3_V4_gate_against_labels", """WITH p AS (SELECT l.doc_id, quality, length(text) >= 400 AS predicted FROM labels l JOIN documents USING (doc_id))
SELECT count(*) AS n, round(count(*) FILTER (WHERE predicted AND quality = 1) / count(*) FILTER (WHERE predicted), 6) AS precision, round(count(*) FILTER (WHERE predicted AND quality = 1) / count(*) FILTER (WHERE quality = 1), 6) AS recall FROM p""")  # fmt: skip
def labels(d):
    from pricetide.operators.evaluate import detection

    both = d.table("labels").join(d.table("documents"), "doc_id").select("quality", (F.length("text") >= 400).alias("predicted"))
    n = lambda c: F.count(F.when(c, 1))
    precision, recall = detection(n(F.col("predicted")), n(F.col("quality") == 1), n(F.col("predicted") & (F.col("quality") == 1)))
    return both.agg(F.count("*").alias("n"), F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"))
