"""Row filters and the flags behind them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..context import CityPack
from ..functions.geo import in_box
from ..functions.hours import open_on
from ..functions.rules import any_contains, any_regex, flag


def complete_places(df: DataFrame) -> DataFrame:
    """Only rows with coordinates and a rating; NaN counts as missing."""
    return df.filter(
        F.col("lat").isNotNull() & F.col("lng").isNotNull() & F.col("rating").isNotNull() & ~F.isnan("rating")
    )


def is_excluded(pack: CityPack, name: Column, primary_type: Column, lat: Column, lng: Column) -> Column:
    placed = lat.isNotNull() & lng.isNotNull()
    return (
        (placed & ~in_box(lat, lng, pack.box))
        | flag(any_regex(F.lower(name), pack.excluded_names))
        | flag(primary_type.isin(pack.excluded_types))
    )


def is_chain(pack: CityPack, name: Column) -> Column:
    return flag(any_regex(F.lower(name), pack.chain_patterns))


def is_shop(pack: CityPack, name: Column) -> Column:
    return flag(any_regex(F.lower(name), pack.shop_patterns))


def drop_shops(df: DataFrame, pack: CityPack) -> DataFrame:
    return df.filter(~is_shop(pack, F.col("name")))


def drop_not_food(df: DataFrame, pack: CityPack) -> DataFrame:
    """Rows without a type stay."""
    return df.filter(~flag(F.col("primary_type").isin(pack.removed_types)))


def drop_closed(df: DataFrame, closed: DataFrame) -> DataFrame:
    """``closed``: one column ``closed_name`` of lower-case names."""
    return df.join(closed, F.lower(df["name"]) == closed["closed_name"], "left_anti")


def missing_ratings(df: DataFrame) -> DataFrame:
    """Rating or number of reviews missing or zero."""
    return df.filter((F.coalesce("rating", F.lit(0.0)) == 0) | (F.coalesce("review_count", F.lit(0)) == 0))


def missing_hours(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce(F.size("closing_times"), F.lit(0)) <= 0)


def worthwhile_candidates(df: DataFrame, pack: CityPack) -> DataFrame:
    """Without shops and hotels by name and without plain fast food."""
    noisy = flag(any_contains(F.lower("name"), pack.candidate_skip_words)) | flag(
        (F.col("amenity") == "fast_food") & F.col("cuisine").isin(pack.fast_food_categories)
    )
    return df.filter(~noisy)


def search_names(df: DataFrame, query: str, regex: bool = True, limit: int | None = None) -> DataFrame:
    """Case-insensitive search in the name: a pattern, or a plain part of it."""
    low, q = F.lower("name"), query.lower()
    out = df.filter(flag(low.rlike("(?U)" + q) if regex else low.contains(q)))
    return out.orderBy("id").limit(limit) if limit else out


GUIDE_TESTS = {
    "michelin": lambda: F.col("michelin_stars") > 0,
    "bib": lambda: F.col("bib_gourmand"),
    "gaultmillau": lambda: F.col("gault_millau"),
    "reddit": lambda: F.col("reddit_mentions") >= 2,
    "afsca": lambda: F.col("has_certificate"),
    "any_guide": lambda: (F.col("michelin_stars") > 0) | F.col("bib_gourmand") | F.col("gault_millau"),
}


@dataclass
class VenueFilter:
    """Parameters of the venue list; empty, zero and 'all' mean no filter."""

    min_rating: float | None = None
    max_rating: float | None = None
    category: str | None = None
    min_reviews: int | None = None
    district: str | None = None
    tier: str | None = None
    venue_type: str | None = None
    community_only: bool = False
    top_scored: bool = False
    search: str = ""
    price: int | None = None
    guide: str | None = None
    open_day: str | None = None
    sort_by: str = "score"

    def before_top(self, df: DataFrame, pack: CityPack) -> DataFrame:
        """Filters that apply before the best-scored cut."""
        if self.min_rating:
            df = df.filter(F.col("rating") >= self.min_rating)
        if self.max_rating:
            df = df.filter(F.col("rating") <= self.max_rating)
        if self.min_reviews:
            df = df.filter(F.col("review_count") >= self.min_reviews)
        for column, value in (
            ("category", self.category), ("district", self.district),
            ("tier", self.tier), ("venue_type", self.venue_type),
        ):
            if value and value != "all":
                df = df.filter(F.col(column) == value)
        if self.community_only:
            df = df.filter(F.col("category").isin(pack.community_categories))
        return df

    def after_top(self, df: DataFrame) -> DataFrame:
        """Filters that apply to what the cut has left."""
        if self.search:
            df = search_names(df, self.search)
        if self.price is not None:
            df = df.filter(F.col("price_numeric") == self.price)
        if self.guide in GUIDE_TESTS:
            df = df.filter(flag(GUIDE_TESTS[self.guide]()))
        if self.open_day:
            df = df.filter(open_on(F.col("opening_hours"), self.open_day))
        return df
