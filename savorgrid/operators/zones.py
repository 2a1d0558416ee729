"""Where a venue lies: nearest district, containing quarter, street, and what they mean.

City lists are short and go into the projection as constants, so none of this shuffles.
For zone tables too large to inline there are cell-blocked joins with the same results.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..context import CityPack
from ..functions.geo import (
    EARTH_KM,
    RadiusCells,
    chord2,
    chord2_of_km,
    fixed_unit_vector,
    haversine_km,
    unit_vector,
)
from ..functions.rules import let
from ..session import ensure_checkpoint_dir
from .similar import dealt


def _zone_array(rows: list[tuple[float, float, dict[str, tuple]]]) -> Column:
    """Constant array of zones: position on the sphere plus named, typed values."""
    kinds = {k: kind for k, (_, kind) in rows[0][2].items()}
    items = []
    for lat, lng, extra in rows:
        x, y, z = fixed_unit_vector(lat, lng)
        items.append({"x": x, "y": y, "z": z, **{k: v for k, (v, _) in extra.items()}})
    schema = ",".join(f"{k}:{kind}" for k, kind in {"x": "double", "y": "double", "z": "double", **kinds}.items())
    return F.from_json(F.lit(json.dumps(items)), f"array<struct<{schema}>>")


def nearest_district(pack: CityPack, lat: Column, lng: Column) -> Column:
    """struct<district, lat, lng, tier, fry>: the first of the closest; the default without a place."""

    def facts(name: str, at: tuple[float | None, float | None], tier: str | None) -> dict[str, tuple]:
        return {
            "district": (name, "string"), "lat": (at[0], "double"), "lng": (at[1], "double"),
            "tier": (tier, "string"), "fry": (pack.fry_shop_scores.get(name), "double"),
        }

    zones = _zone_array([(d.lat, d.lng, facts(d.name, (d.lat, d.lng), d.tier)) for d in pack.districts])
    near = let(
        unit_vector(lat, lng),
        lambda u: let(
            # to a billionth of a square kilometre, so that equal distances are equal numbers
            F.transform(zones, lambda z: F.rint(chord2(u, z) * F.lit(EARTH_KM**2 * 1e9))),
            lambda ds: F.element_at(zones, F.array_position(ds, F.array_min(ds)).cast("int")),
        ),
    )
    tiers = {d.name: d.tier for d in pack.districts}
    default = facts(pack.default_district, (None, None), tiers.get(pack.default_district))
    fallback = F.struct(*[F.lit(v).cast(kind).alias(k) for k, (v, kind) in default.items()])
    found = let(near, lambda z: F.struct(*[z[k].alias(k) for k in default]))
    return F.when(lat.isNotNull() & lng.isNotNull(), found).otherwise(fallback)


def _first_circle(zones: Column, lat: Column, lng: Column, inclusive: bool) -> Column:
    """First zone whose circle (``c2``: squared chord of its radius) holds the point."""

    def inside(u: Column, z: Column) -> Column:
        return chord2(u, z) <= z["c2"] if inclusive else chord2(u, z) < z["c2"]

    return let(
        unit_vector(lat, lng), lambda u: F.try_element_at(F.filter(zones, lambda z: inside(u, z)), F.lit(1))
    )


def containing_quarter(pack: CityPack, lat: Column, lng: Column) -> Column:
    """struct<quarter, tier> of the first quarter closer than its radius; null outside all."""
    if not pack.quarters:
        return F.lit(None).cast("struct<quarter:string,tier:string>")
    zones = _zone_array(
        [
            (
                q.lat, q.lng,
                {"quarter": (q.name, "string"), "tier": (q.tier, "string"), "c2": (chord2_of_km(q.radius), "double")},
            )
            for q in pack.quarters
        ]
    )
    hit = _first_circle(zones, lat, lng, inclusive=False)
    return let(hit, lambda z: F.when(z.isNotNull(), F.struct(z["quarter"].alias("quarter"), z["tier"].alias("tier"))))


def on_street(pack: CityPack, lat: Column, lng: Column) -> Column:
    """Name of the first listed street within its own radius."""
    if not pack.streets:
        return F.lit(None).cast("string")
    zones = _zone_array(
        [(s.lat, s.lng, {"street": (s.name, "string"), "c2": (chord2_of_km(s.radius), "double")}) for s in pack.streets]
    )
    return _first_circle(zones, lat, lng, inclusive=True)["street"]


def street_words(pack: CityPack, name: Column) -> Column:
    """Words of a street name that carry meaning."""
    bare = F.regexp_replace(F.lower(name), r"(?U)[()\s]+", " ")
    stop = F.array(*[F.lit(w) for w in ["", *pack.stop_words]])
    return F.array_except(F.split(bare, " "), stop)


def known_street_words(pack: CityPack, category_streets: Column) -> Column:
    """All meaningful words of the streets known for a category; meant for the lookup table."""
    return F.array_distinct(F.flatten(F.transform(category_streets, lambda s: street_words(pack, s["name"]))))


def street_fits_category(pack: CityPack, street: Column, known_words: Column) -> Column:
    """Does the street share a word with any street known for the category?"""
    fits = F.arrays_overlap(street_words(pack, street), known_words)
    return F.when(street.isNotNull() & known_words.isNotNull(), fits).otherwise(F.lit(False))


def area_tier(district: Column, quarter: Column) -> Column:
    return F.coalesce(quarter["tier"], district["tier"], F.lit("mixed"))


def with_zones(df: DataFrame, pack: CityPack) -> DataFrame:
    """Adds district, quarter, street, area_tier and the distances to the two anchor points."""
    lat, lng = F.col("lat"), F.col("lng")
    return (
        df.withColumns(
            {
                "_district": nearest_district(pack, lat, lng),
                "_quarter": containing_quarter(pack, lat, lng),
                "street": on_street(pack, lat, lng),
                "centre_km": haversine_km(lat, lng, *pack.centre),
                "office_km": haversine_km(lat, lng, *pack.office_hub),
            }
        )
        .withColumns(
            {
                "district": F.col("_district.district"),
                "district_tier": F.col("_district.tier"),
                "fry_score": F.col("_district.fry"),
                "quarter": F.col("_quarter.quarter"),
                "area_tier": area_tier(F.col("_district"), F.col("_quarter")),
            }
        )
        .drop("_district", "_quarter")
    )


def with_affinity(df: DataFrame, affinity: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds ``affinity``: community score of (category, district), 0.2 where the category is
    known but not the district, at least the local score."""
    known = categories.select("category", "has_affinity")
    joined = df.join(affinity, ["category", "district"], "left").join(known, "category", "left")
    return joined.withColumn("affinity", affinity_score()).drop("community", "local", "has_affinity")


def affinity_score() -> Column:
    base = F.coalesce(
        F.col("community"), F.when(F.coalesce("has_affinity", F.lit(False)), F.lit(0.2)), F.lit(0.0)
    )
    return F.greatest(base, F.coalesce("local", F.lit(0.0)))


def community_context(category_streets: Column, affinity: Column, note: Column) -> Column:
    """struct<in_area, streets, note>: up to three streets of the category in the district or
    less than a kilometre away."""
    lat, lng, district = F.col("lat"), F.col("lng"), F.col("district")
    tagged = F.transform(
        category_streets,
        lambda s: F.when(s["district"] == district, s["name"]).when(
            haversine_km(lat, lng, s["lat"], s["lng"]) < 1.0,
            F.concat(s["name"], F.lit(" ("), s["district"], F.lit(")")),
        ),
    )
    return F.struct(
        F.coalesce(affinity >= 0.7, F.lit(False)).alias("in_area"),
        F.coalesce(F.slice(F.array_compact(tagged), 1, 3), F.array().cast("array<string>")).alias("streets"),
        note.alias("note"),
    )


# --- zone tables too large to inline --------------------------------------------

def _points(df: DataFrame) -> DataFrame:
    """The different places of the rows. A zone depends on nothing else, so rows without an id or with a
    common one find theirs, and a crowded place is looked up once."""
    return df.select("lat", "lng").where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).distinct()


def _with_found(df: DataFrame, found: DataFrame) -> DataFrame:
    return df.join(found, ["lat", "lng"], "left").select(*df.columns, "zone")


#: Cells from the centre to the edge of a zone of the largest radius.
FINE = 4

#: Kilometres by which a zone must reach over a cell to count as covering it, far above rounding.
_SURE_KM = 1e-6


def _zone_cells(zones: DataFrame, cells: RadiusCells) -> DataFrame:
    """_cell, ord, lat, lng, radius of the zones that can hold a place of each cell and come first there.

    A zone that covers a cell whole holds all its places, so zones with a higher ``ord`` are never the first
    there. What is left are the zones whose edges cross the cell before the first cover, however many zones overlap.
    """
    reached = dealt(zones).select("ord", "lat", "lng", "radius", F.explode(cells.reach(F.col("lat"), F.col("lng"), F.col("radius"))).alias("_c"))
    far = cells.farthest_km(F.col("_c.row"), F.col("_c.col"), F.col("lat"), F.col("lng"))
    reached = reached.select(F.col("_c.cell").alias("_cell"), "ord", "lat", "lng", "radius", (far < F.col("radius") - _SURE_KM).alias("_whole"))
    first = reached.where("_whole").groupBy("_cell").agg(F.min("ord").alias("_first"))
    # sorted joins: the zones of a cell are never sent through the driver, whatever their files' size
    return reached.join(first.hint("merge"), "_cell", "left").where("_first is null or ord <= _first").select("_cell", "ord", "lat", "lng", "radius")


def containing_zone(df: DataFrame, zones: DataFrame, max_radius_km: float, inclusive: bool = False) -> DataFrame:
    """First zone (lowest ``ord``) that contains each venue, as struct ``zone``.

    ``zones``: ord, name, lat, lng, radius plus anything else. Zones are spread over the small cells they
    can reach, and only those that can be the first in a cell are met there; each place keeps its one home
    cell. The least ord is a number, summed up in the tasks; whole zones are fetched for one ord a place. Of zones
    with one ord the least by its other columns counts. Rows without coordinates have no zone.
    """
    cells = RadiusCells(max_radius_km * 1000.0 / FINE)
    homed = _points(df).withColumn("_cell", cells.home(F.col("lat"), F.col("lng")))
    near = _zone_cells(zones, cells).select("_cell", F.col("ord").alias("_ord"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), F.col("radius").alias("_radius"))

    def inside(lat: Column, lng: Column, radius: Column) -> Column:
        dist = haversine_km(F.col("lat"), F.col("lng"), lat, lng)
        return dist <= radius if inclusive else dist < radius

    least = (
        homed.join(near.hint("merge"), "_cell")
        .where(inside(F.col("_lat"), F.col("_lng"), F.col("_radius")))
        .groupBy("lat", "lng")
        .agg(F.min("_ord").alias("_ord"))
    )
    zone = F.struct(F.col("ord"), *[F.col(c) for c in zones.columns if c != "ord"])
    whole = zones.select(F.col("ord").alias("_ord"), zone.alias("zone"))
    hits = (
        least.join(whole.hint("merge"), "_ord")
        .where(inside(F.col("zone.lat"), F.col("zone.lng"), F.col("zone.radius")))
        .groupBy("lat", "lng")
        .agg(F.min("zone").alias("zone"))
    )
    return _with_found(df, hits)


def nearest_zone(df: DataFrame, zones: DataFrame, start_km: float = 1.0) -> DataFrame:
    """Nearest zone of a large table as struct ``zone<dist, ord, name>``.

    Looks within a radius, keeps what is certain (anything nearer would lie in the same
    cells) and doubles the radius for the rest, until no place is left.
    """
    ensure_checkpoint_dir(df.sparkSession)
    found, open_rows, radius = None, _points(df), start_km
    farthest = EARTH_KM * 3.2  # more than half the way round the globe
    while True:
        cells = RadiusCells(radius * 1000.0)
        spread = zones.select(
            F.explode(cells.around(F.col("lat"), F.col("lng"))).alias("_cell"),
            F.col("ord").alias("_ord"), F.col("name").alias("_name"),
            F.col("lat").alias("_lat"), F.col("lng").alias("_lng"),
        )
        dist = haversine_km(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng"))
        step = (
            open_rows.withColumn("_cell", cells.home(F.col("lat"), F.col("lng")))
            .join(spread, "_cell")
            .filter(dist <= radius)
            .groupBy("lat", "lng")
            .agg(F.min(F.struct(dist.alias("dist"), F.col("_ord").alias("ord"), F.col("_name").alias("name"))).alias("zone"))
            .checkpoint()
        )
        found = step if found is None else found.unionByName(step)
        open_rows = open_rows.join(step.select("lat", "lng"), ["lat", "lng"], "left_anti")
        radius *= 2
        if radius > farthest or open_rows.isEmpty():
            break
    return _with_found(df, found)
