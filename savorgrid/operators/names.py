"""Lookups by name: mention counts, guide phrases, institutions, category rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..context import CityPack
from ..functions.rules import any_contains, first_match, flag, label_of, let
from ..functions.text import is_fry_shop, key_name, plain_name


def category(pack: CityPack, name: Column, primary_type: Column, types: Column) -> Column:
    """Name override, then primary type, then first known type, then name keywords, else 'Other'."""
    low = F.lower(name)
    by_type = F.try_element_at(
        F.filter(
            F.transform(types, lambda t: label_of(t, pack.type_categories)), lambda c: c.isNotNull()
        ),
        F.lit(1),
    )
    return F.coalesce(
        first_match(low, pack.category_overrides).cast("string"),
        label_of(primary_type, pack.type_categories),
        by_type,
        first_match(low, pack.category_keywords).cast("string"),
        F.lit("Other"),
    )


# Kinds of venue in priority order, and name cues for a bar.
VENUE_KINDS = ["restaurant", "cafe", "bar", "bakery", "meal_takeaway"]
BAR_CUES = ["café", "cafe", " bar ", " bar,", "bar ", "(bar)", "le bar", "the bar"]


def venue_type(name: Column, primary_type: Column, types: Column) -> Column:
    low = F.lower(name)
    out = F.when(primary_type == "sandwich_shop", "Sandwich_shop").when(
        primary_type == "fast_food_restaurant", "Fast_food"
    )
    for kind in VENUE_KINDS:
        out = out.when(primary_type.contains(kind), kind.capitalize())
    for kind in VENUE_KINDS:
        out = out.when(F.array_contains(types, kind), kind.capitalize())
    bar = any_contains(low, BAR_CUES) & ~any_contains(low, ["restaurant", "resto"])
    return out.when(bar, "Bar").otherwise("Restaurant")


# --- guides ---------------------------------------------------------------------

def name_phrases(name: Column, max_length: int) -> Column:
    """Distinct parts of the name that start and end next to a character outside a-z."""

    def phrases(low: Column) -> Column:
        size = F.length(low)

        def other(at: Column) -> Column:
            c = F.substring(low, at, F.lit(1))  # one character, so comparing texts is comparing letters
            return (c < "a") | (c > "z")

        places = F.sequence(F.lit(1), size)
        starts, ends = F.filter(places, lambda i: (i == 1) | other(i - 1)), F.filter(places, lambda j: (j == size) | other(j + 1))

        def parts(bounds: Column) -> Column:
            return F.transform(
                bounds["starts"],
                lambda i: F.transform(
                    F.filter(bounds["ends"], lambda j: (j >= i) & (j - i < max_length)),
                    lambda j: F.substring(low, i, j - i + 1),
                ),
            )

        bounds = F.struct(starts.alias("starts"), ends.alias("ends"))
        return F.when(size > 0, F.array_distinct(F.flatten(let(bounds, parts))))

    return let(F.lower(name), phrases)


def with_guides(df: DataFrame, pack: CityPack) -> DataFrame:
    """Adds michelin_stars, bib_gourmand, gault_millau.

    A name becomes its boundary phrases once, and each is looked up in the lists by hash, so the work
    follows the names, however long the lists; rows are not joined, so ids may be null or repeated.
    Of several starred names in one the first listed counts.
    """
    low = F.lower("name")
    starred = list(pack.star_names)
    longest = max(map(len, [*starred, *pack.bib_names, *pack.guide_names]), default=0)
    order = F.split(F.lit("\x01".join(starred)), "\x01")
    values = F.split(F.lit(",".join(map(str, pack.star_names.values()))), ",")
    exact = first_match(low, [(v, [n]) for n, v in pack.star_exact.items()], mode="equals")

    def badges(phrases: Column) -> Column:
        found = F.transform(F.filter(phrases, lambda p: p.isin(starred)), lambda p: F.array_position(order, p))
        listed = F.try_element_at(values, F.array_min(found).cast("int")).cast("int")
        return F.struct(
            F.coalesce(exact.cast("int"), listed, F.lit(0)).alias("stars"),
            flag(F.exists(phrases, lambda p: p.isin(pack.bib_names))).alias("bib"),
            (flag(F.exists(phrases, lambda p: p.isin(pack.guide_names))) | flag(low.isin(pack.guide_exact))).alias("guide"),
        )

    # a generated row, so that filters on the badges use what is there and do not search the name again
    out = df.withColumn("_badges", F.explode(F.array(let(name_phrases(F.col("name"), longest), badges))))
    return out.withColumns(
        {
            "michelin_stars": F.col("_badges.stars"),
            "bib_gourmand": F.col("_badges.bib"),
            "gault_millau": F.col("_badges.guide"),
        }
    ).drop("_badges")


def guide_bonus(stars_: Column, bib: Column, guide: Column) -> Column:
    """Highest badge only; shown, not scored."""
    return F.when(stars_ >= 2, 0.08).when(stars_ == 1, 0.06).when(bib, 0.04).when(guide, 0.03).otherwise(0.0)


# --- other lookups ----------------------------------------------------------------

def institution_score(pack: CityPack, name: Column) -> Column:
    """Score of the first institution whose key is part of the name, with or without accents."""
    if not pack.institutions:
        return F.lit(None).cast("double")

    def score(n: Column) -> Column:
        out = None
        for key, value in pack.institutions.items():
            cond = n["low"].contains(key) | n["plain"].contains(key)
            out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
        return out

    return let(F.struct(key_name(name).alias("low"), plain_name(name).alias("plain")), score).cast("double")


def local_icon_score(pack: CityPack, name: Column, district_fry_score: Column) -> Column:
    """Institution, else a fry shop in a district that has a score for them, else 0."""
    fry = F.when(is_fry_shop(name), district_fry_score)
    return F.when(name.isNull() | (name == ""), 0.0).otherwise(
        F.coalesce(institution_score(pack, name), fry, F.lit(0.0))
    )


def with_mentions(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """Adds ``reddit_mentions`` by exact lower-cased, stripped name. ``lookup``: key, mentions."""
    return (
        df.join(lookup, key_name(df["name"]) == lookup["key"], "left")
        .withColumn("reddit_mentions", F.coalesce("mentions", F.lit(0)).cast("bigint"))
        .drop("key", "mentions")
    )


def mention_score(mentions: Column, reviews: Column) -> Column:
    base = (
        F.when(mentions >= 10, 1.0).when(mentions >= 5, 0.8).when(mentions >= 3, 0.6).when(mentions >= 2, 0.4)
        .when(mentions >= 1, 0.2).otherwise(0.0)
    )
    size = F.when((reviews > 0) & (reviews < 200), 1.2).when(reviews > 2000, 0.7).otherwise(1.0)
    return F.least(F.lit(1.0), base * size)
