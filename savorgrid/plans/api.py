"""The queries a venue map asks, composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..context import CityPack
from ..operators import ranking as rk
from ..operators import reports as rp
from ..operators.filters import VenueFilter
from ..operators.ingest import present_columns
from ..session import materialise
from .score import COMPONENTS

LIST_COLUMNS = [
    "id", "name", "address", "lat", "lng", "rating", "review_count",
    "category", "venue_type", "price_numeric", "is_chain",
    "predicted_rating", "residual", "google_maps_url",
    "district", "quarter", "diaspora_street", "tier", "commune_tier", "score",
    *[f"score_{c}" for c in COMPONENTS],
    "horseshoe_bonus", "horseshoe_type", "closes_early", "typical_close_hour", "weekdays_only", "closed_sunday",
    "days_open_count", "is_rare_category", "opening_hours",
    "michelin_stars", "bib_gourmand", "gault_millau", "reddit_mentions", "has_certificate",
    "scarcity_review_scarcity", "scarcity_hours_scarcity", "scarcity_days_scarcity",
    "scarcity_schedule_scarcity", "scarcity_cuisine_scarcity",
]

GEM_COLUMNS = [
    "id", "name", "address", "category", "rating", "review_count", "predicted_rating", "residual", "lat", "lng",
    "google_maps_url",
]


def flat_scores(scored: DataFrame) -> DataFrame:
    """Components and scarcity parts as columns of their own, as the list shows them."""
    if "components" not in scored.columns:
        return scored
    cols = {f"score_{c}": F.col(f"components.{c}") for c in COMPONENTS}
    cols |= {
        "scarcity_review_scarcity": F.col("review_scarcity"),
        "scarcity_cuisine_scarcity": F.col("cuisine_scarcity"),
        "scarcity_hours_scarcity": F.lit(0),
        "scarcity_days_scarcity": F.lit(0),
        "scarcity_schedule_scarcity": F.lit(0),
    }
    return scored.withColumns(cols)


def list_venues(scored: DataFrame, pack: CityPack, f: VenueFilter) -> DataFrame:
    """Filtered, sorted venue list.

    Search, price, guide and weekday apply to the best-scored hundred when that cut is on.
    """
    rows = f.before_top(scored, pack)
    if f.top_scored and "score" in rows.columns:
        rows = rk.top_n(rows, "score", 100)
    rows = rk.sort_venues(f.after_top(rows), f.sort_by)
    return present_columns(flat_scores(rows), LIST_COLUMNS)


def residual_gems(scored: DataFrame, limit: int = 50) -> DataFrame:
    return present_columns(rk.gems(scored, limit), [*GEM_COLUMNS, "undervaluation_pct"])


def score_gems(scored: DataFrame, limit: int = 50, district: str | None = None) -> DataFrame:
    rows = scored if not district or district == "all" else scored.filter(F.col("district") == district)
    return present_columns(rk.top_n(rows, "score", limit), [*GEM_COLUMNS, "district", "quarter", "tier", "score"])


def community_venues(scored: DataFrame, pack: CityPack, limit: int = 50) -> DataFrame:
    rows = rk.subset_top(scored, "category", pack.community_categories, limit)
    return present_columns(
        rows,
        ["id", "name", "address", "category", "rating", "review_count", "lat", "lng", "google_maps_url", "district", "score"],
    )


def vocabularies(scored: DataFrame) -> DataFrame:
    return rp.vocabulary(scored, ["category", "district", "tier"])


def ranking_report(scored: DataFrame, pack: CityPack) -> DataFrame:
    """Five top lists in one table: section, id, name, category, district, value.

    All lists read the same few columns, which are written once instead of being scored five times.
    """
    scored = materialise(scored.select("id", "name", "category", "district", "rating", "score"))

    def section(label: str, rows: DataFrame, value: str) -> DataFrame:
        return rows.select(
            F.lit(label).alias("section"), "id", "name", "category", "district",
            F.col(value).cast("double").alias("value"),
        )

    parts = [
        section("top", rk.top_n(scored, "score", 20), "score"),
        section("district", rk.top_per_group(scored, "district", "score"), "score"),
        section("winners", rk.winners(scored), "rank_improvement"),
        section("community", rk.subset_top(scored, "category", pack.community_categories, 10), "score"),
        section("spotlight", rk.subset_top(scored, "district", pack.spotlight_districts, 10), "score"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
