"""From raw payloads and map elements to flat venue rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..context import OSM_CATEGORIES
from ..functions.hours import closing_times, open_days
from ..functions.rules import label_of


def flatten_places(payloads: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Nested place payloads to the flat place record, with its defaults."""
    hours = F.col("regularOpeningHours")
    no_text, no_list = F.lit(""), F.array().cast("array<string>")
    return payloads.select(
        "id",
        F.coalesce(F.col("displayName.text"), no_text).alias("name"),
        F.coalesce("formattedAddress", no_text).alias("address"),
        F.col("location.latitude").alias("lat"),
        F.col("location.longitude").alias("lng"),
        "rating",
        F.coalesce(F.col("userRatingCount"), F.lit(0)).alias("review_count"),
        F.col("priceLevel").alias("price_level"),
        F.coalesce("types", no_list).alias("types"),
        F.coalesce("primaryType", no_text).alias("primary_type"),
        F.coalesce(F.col("primaryTypeDisplayName.text"), no_text).alias("primary_type_display"),
        F.col("websiteUri").alias("website"),
        F.col("googleMapsUri").alias("google_maps_url"),
        F.coalesce(hours["weekdayDescriptions"], no_list).alias("opening_hours"),
        closing_times(hours["periods"]).alias("closing_times"),
        open_days(hours["periods"]).alias("days_open"),
        *extra,
    )


def structured_hours(payloads: DataFrame) -> DataFrame:
    """id with its opening days and closing times."""
    periods = F.col("regularOpeningHours.periods")
    return payloads.select("id", open_days(periods).alias("days_open"), closing_times(periods).alias("closing_times"))


def osm_category(cuisine: Column) -> Column:
    """First ';' token through the map, else in title case, else 'Restaurant'."""
    token = F.trim(F.split_part(F.coalesce(cuisine, F.lit("")), F.lit(";"), F.lit(1)))
    known = label_of(F.lower(token), OSM_CATEGORIES)
    return F.coalesce(known, F.when(token == "", F.lit("Restaurant")).otherwise(_title(token)))


def _title(text: Column) -> Column:
    """Every run of letters starts with a capital, the rest is lower case."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def _osm_point(strict_way: bool) -> tuple[Column, Column]:
    if strict_way:  # a way only counts by its centre
        node = F.col("type") == "node"
        return F.when(node, F.col("lat")).otherwise(F.col("center.lat")), F.when(node, F.col("lon")).otherwise(
            F.col("center.lon")
        )
    return (
        F.coalesce(F.nullif("lat", F.lit(0.0)), F.col("center.lat")),
        F.coalesce(F.nullif("lon", F.lit(0.0)), F.col("center.lon")),
    )


def _tag(name: str) -> Column:
    return F.try_element_at(F.col("tags"), F.lit(name))


def _given(value: Column) -> Column:
    return F.when(value != "", value)


def flatten_osm(elements: DataFrame, default_address: str = "") -> DataFrame:
    """Map elements with a name and a place to venue rows with address text and category.

    ``default_address`` stands in where an element has no address tags.
    """
    lat, lng = _osm_point(strict_way=True)
    street = F.trim(F.concat_ws(" ", _given(_tag("addr:street")), _tag("addr:housenumber")))
    address = F.concat_ws(
        ", ",
        F.when(_given(_tag("addr:street")).isNotNull(), street),
        _given(_tag("addr:postcode")),
        _given(_tag("addr:city")),
    )
    texts = ("website", "phone", "opening_hours", "wheelchair", "outdoor_seating")
    return (
        elements.select(
            F.col("id").alias("osm_id"),
            F.col("type").alias("osm_type"),
            _tag("name").alias("name"),
            F.when(address == "", F.lit(default_address)).otherwise(address).alias("address"),
            lat.alias("lat"),
            lng.alias("lng"),
            osm_category(_tag("cuisine")).alias("cuisine"),
            F.coalesce(_tag("amenity"), F.lit("restaurant")).alias("amenity"),
            *[F.coalesce(_tag(t), F.lit("")).alias(t) for t in texts],
            F.lit(None).cast("double").alias("rating"),
            F.lit(None).cast("bigint").alias("review_count"),
        )
        .filter((F.col("lat") != 0) & (F.col("lng") != 0))
        .filter(F.col("name") != "")
    )


def osm_attributes(elements: DataFrame) -> DataFrame:
    """The attribute variant: seating, access and diet tags as they are."""
    lat, lng = _osm_point(strict_way=False)
    return (
        elements.select(
            F.col("id").alias("osm_id"),
            F.col("type").alias("osm_type"),
            _tag("name").alias("name"),
            lat.alias("lat"),
            lng.alias("lng"),
            _tag("amenity").alias("amenity"),
            _tag("cuisine").alias("cuisine"),
            _tag("outdoor_seating").alias("outdoor_seating"),
            _tag("wheelchair").alias("wheelchair"),
            _tag("diet:vegan").alias("diet_vegan"),
            _tag("diet:vegetarian").alias("diet_vegetarian"),
            _tag("diet:halal").alias("diet_halal"),
            F.coalesce(_given(_tag("phone")), _tag("contact:phone")).alias("osm_phone"),
            F.coalesce(_given(_tag("website")), _tag("contact:website")).alias("osm_website"),
            _tag("opening_hours").alias("osm_opening_hours"),
        )
        .filter((F.col("lat") != 0) & (F.col("lng") != 0))
        .filter(F.col("name") != "")
    )


def cover_grid(areas: DataFrame) -> DataFrame:
    """Search points over bounding boxes.

    ``areas``: area, south, west, north, east, step_km, radius. One row per grid point;
    a degree of latitude counts as 111 km and one of longitude as 71 km.
    """
    lat_step, lng_step = F.col("step_km") / F.lit(111.0), F.col("step_km") / F.lit(71.0)

    def steps(lo: str, hi: str, step: Column) -> Column:
        return F.sequence(F.lit(0), F.floor((F.col(hi) - F.col(lo)) / step).cast("int"))

    # an inverted box has no points; a descending sequence must not invent any
    return (
        areas.filter((F.col("north") >= F.col("south")) & (F.col("east") >= F.col("west")))
        .withColumn("i", F.explode(steps("south", "north", lat_step)))
        .withColumn("j", F.explode(steps("west", "east", lng_step)))
        .select(
            "area",
            "i",
            "j",
            (F.col("south") + F.col("i") * lat_step).alias("lat"),
            (F.col("west") + F.col("j") * lng_step).alias("lng"),
            "radius",
        )
    )


def present_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order, with NaN as null."""
    kinds = dict(df.dtypes)
    out = []
    for c in wanted:
        if c in kinds:
            col = F.col(c)
            out.append(F.when(~F.isnan(col), col).alias(c) if kinds[c] in ("double", "float") else col)
    return df.select(*out)
