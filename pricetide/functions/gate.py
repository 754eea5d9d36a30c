"""Completeness rules and the quality gate over extraction columns (snake-case names of the extraction record)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricetide.functions.text import identity_label

LEAST_CONFIDENCE, REVIEW_BELOW = 0.40, 0.60


def _given(name: str) -> Column:
    return F.coalesce(F.col(name) != "", F.lit(False))


def has_identity() -> Column:
    return _given("project_name") | _given("name") | _given("location_text")


def missing_fields() -> Column:
    """Labels of the required fields that are missing, in order."""
    rules = {
        "price": F.col("price_vnd").isNull(),
        "price basis (total or per m²)": F.col("price_basis") == "unknown",
        "listing type (sale or rent)": F.col("listing_type") == "unknown",
        "area (m²)": F.col("area_m2").isNull(),
        "project/property identity or location": ~has_identity(),
    }
    return F.array_compact(F.array(*(F.when(rule, label) for label, rule in rules.items())))


def is_complete() -> Column:
    return F.size(missing_fields()) == 0


def rejection_reason() -> Column:
    """The first rule that an extraction fails, or null."""
    confidence = F.format_string(f"confidence too low (%.2f < {LEAST_CONFIDENCE:.1f})", F.col("confidence").cast("double"))
    no_price = F.col("price_vnd").isNull()
    return (
        F.when(F.col("confidence") < LEAST_CONFIDENCE, confidence)
        .when(~has_identity(), "lacks identity or location")
        .when(F.col("listing_type") == "unknown", "unknown listing type (neither sale nor rent)")
        .when(no_price & F.col("area_m2").isNull(), "lacks both price and area")
        .when(no_price & (F.col("listing_type") == "sale"), "sale listing lacks price")
    )


def is_usable() -> Column:
    return rejection_reason().isNull()


def has_specific_identity() -> Column:
    """An apartment inside a project or building needs a unit number."""
    return ~((F.col("type") == "apartment") & (_given("project_name") | _given("building_name")) & ~_given("house_number"))


def should_review() -> Column:
    return (F.col("confidence") < REVIEW_BELOW) | ~has_identity() | ~has_specific_identity()


def price_per_m2(price: str = "price_vnd", area: str = "area_m2", basis: str = "price_basis") -> Column:
    """The price itself if it is per m², price over area if it is a total, else null."""
    per = F.when(F.col(area) > 0, F.round(F.col(price) / F.col(area)))
    return F.when(F.col(basis) == "per_m2", F.col(price)).when(F.col(basis) == "total", per)


def incomplete_line(position: Column) -> Column:
    """"#i label: needs a, b" of an incomplete extraction at a position from 0, else null."""
    label = identity_label("project_name", "building_name", "house_number", "name", "location_text")
    missing = missing_fields()
    return F.when(F.size(missing) > 0, F.concat(F.lit("#"), (position + 1).cast("string"), F.lit(" "), label, F.lit(": needs "), F.array_join(missing, ", ")))
