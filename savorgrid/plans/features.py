"""Feature table: clean, exclude, derive per row, aggregate per cell, join back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..context import CityPack
from ..functions.geo import HexGrid
from ..functions.hours import day_profile, weekday_close
from ..functions.money import price_number
from ..functions.numeric import log_reviews
from ..operators import filters as flt
from ..operators import names as nm
from ..operators.cells import add_cell_features


def row_features(df: DataFrame, pack: CityPack, grid: HexGrid) -> DataFrame:
    """Everything that needs only the row itself; no shuffle."""
    name, ptype = F.col("name"), F.col("primary_type")
    kept = flt.complete_places(df).filter(~flt.is_excluded(pack, name, ptype, F.col("lat"), F.col("lng")))
    have = set(df.columns)
    closing = F.col("closing_times") if "closing_times" in have else F.lit(None).cast("map<int,string>")
    days = F.col("days_open") if "days_open" in have else F.lit(None).cast("array<int>")
    return (
        kept.withColumns(
            {
                "log_review_count": log_reviews(F.col("review_count")),
                "is_chain": flt.is_chain(pack, name),
                "category": nm.category(pack, name, ptype, F.col("types")),
                "venue_type": nm.venue_type(name, ptype, F.col("types")),
                "price_numeric": price_number(F.col("price_level")),
                "cell": grid.cell(F.col("lat"), F.col("lng")),
                "_close": weekday_close(closing),
                "_days": day_profile(days),
            }
        )
        .withColumns(
            {
                "closes_early": F.col("_close.early"),
                "typical_close_hour": F.col("_close.hour"),
                "days_open_count": F.col("_days.days_open_count"),
                "closed_weekends": F.col("_days.closed_weekends"),
                "closed_sunday": F.col("_days.closed_sunday"),
                "weekdays_only": F.col("_days.weekdays_only"),
            }
        )
        .drop("_close", "_days")
    )


def build_features(df: DataFrame, pack: CityPack, grid: HexGrid) -> DataFrame:
    return add_cell_features(row_features(df, pack, grid))
