"""Matching place records from two sources by distance and name.

A radius join is an equi-join on tiles several times as wide as the radius: the larger side is
shuffled as it is, the smaller one with a copy for each tile that its surroundings touch, some
two a record. Copies (same comparable name at the same point) are collapsed before it. Who shares
a tile meets; what is too far off by its degrees goes first, and words are only compared
where bit masks let two be shared. In a crowded cell, known from a table of counts, the join key also
carries a piece of the name, chosen so that no pair the text rules accept is lost. What is left per
record is folded to its first match while still map-side.

The sides are written once and met by sorting: what Spark knows of a file is its compressed size, and repeated
names compress so well that it would send millions of rows through the driver as a broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..context import CityPack
from ..functions.geo import KM_PER_DEGREE, RadiusCells, haversine_m
from ..functions.text import key_name, normalise_endings, normalise_quotes, words
from ..session import ensure_checkpoint_dir, materialise
from .filters import worthwhile_candidates

#: Lengths of name pieces; the longest that fits into a name opens its key.
GRAMS = [8, 4, 2, 1]

#: A cell with more records of the answering side is crowded. There a record is written some hundred times, once for
#: each piece of its name, where else it is written once or twice and held against those around it.
CROWD = 1024

#: Width of a tile in radii. Wider ones take fewer copies, and more records meet that are too far off.
TILE = 4

NameRule = Callable[[Column], Column]


# --- name pieces that must be shared -------------------------------------------------

def contains_either(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def shared_words(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(words(a), words(b)))


def word_mask(name: Column) -> Column:
    """A bit of 63 for each word; the sign bit says that two words have the same one."""
    ws = words(name)
    bits = F.transform(ws, lambda w: F.pmod(F.xxhash64(w), F.lit(63)).cast("int"))
    mask = F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b)))
    return F.when(F.size(F.array_distinct(bits)) < F.size(ws), mask.bitwiseOR(F.lit(-(1 << 63)))).otherwise(mask)


def may_share_two(a: Column, b: Column) -> Column:
    """Whether names of these masks can have two words in common; true wherever they do."""
    return (a < 0) | (F.bit_count(a.bitwiseAND(b)) >= 2)


def _prefix_key(name: Column) -> Column:
    opening = F.lit("")
    for n in reversed(GRAMS):
        opening = F.when(F.length(name) >= n, F.substring(name, 1, n)).otherwise(opening)
    return F.array(F.concat(F.lit("p"), opening))


def _piece_keys(name: Column) -> Column:
    """Every piece of those lengths: contains the prefix key of any name inside this one."""
    size = F.length(name)
    pieces = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.greatest(size, F.lit(1))),
            lambda i: F.array(*[F.substring(name, i, F.lit(n)) for n in GRAMS]),
        )
    )
    return F.transform(F.array_distinct(F.array_append(pieces, F.lit(""))), lambda p: F.concat(F.lit("p"), p))


def _word_pair_keys(name: Column) -> Column:
    ws = F.array_sort(words(name))
    return F.flatten(
        F.transform(
            ws,
            lambda a: F.transform(
                F.filter(ws, lambda b: b > a), lambda b: F.concat(F.lit("w"), a, F.lit(" "), b)
            ),
        )
    )


# --- blocked pairs ---------------------------------------------------------------------

def _collapse(df: DataFrame, rule: NameRule, order: str, prefix: str) -> DataFrame:
    """Distinct (comparable name, lat, lng) with the first position in list order."""
    placed = df.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    distinct = placed.groupBy(
        rule(F.col("name")).alias(f"{prefix}n"), F.col("lat").alias(f"{prefix}lat"), F.col("lng").alias(f"{prefix}lng")
    ).agg(F.min(order).alias(f"{prefix}ord"))
    # the blocked joins read this several times, so it is written once
    return materialise(distinct)


def _near(e: DataFrame, v: DataFrame, radius_m: float, with_words: bool, crowd: int) -> DataFrame:
    """Pairs that can be near enough and can satisfy the text rules.

    Where at most ``crowd`` records of ``v`` are at home in a cell, its tile is the whole key. In the others the side
    whose name may be the inner one looks around with its opening, and the other one answers at home with
    all its pieces; a pair's path depends on the cell of ``v`` alone, so each path is whole by itself.
    """
    cells = RadiusCells(radius_m)

    def around(side: str) -> Column:
        return F.explode(cells.around(F.col(f"{side}lat"), F.col(f"{side}lng")))

    def home(side: str) -> Column:
        return cells.home(F.col(f"{side}lat"), F.col(f"{side}lng"))

    def text_keys(name: Column, own: Callable[[Column], Column]) -> Column:
        keys = own(name)
        return F.array_union(keys, _word_pair_keys(name)) if with_words else keys

    def keyed(df: DataFrame, keys: Column) -> DataFrame:
        return df.withColumn("key", F.explode(keys))

    at_home = v.withColumn("cell", home("v"))
    crowded = materialise(at_home.groupBy("cell").count().filter(F.col("count") > crowd).select("cell"))
    if crowded.isEmpty():
        return _met(e, v, radius_m)
    met = _met(e, at_home.join(crowded, "cell", "left_anti").drop("cell"), radius_m)
    looking = e.withColumn("cell", around("e"))
    en, vn = F.col("en"), F.col("vn")
    v_crowded = at_home.join(crowded, "cell", "left_semi")
    inner_e = keyed(looking.join(crowded, "cell", "left_semi"), text_keys(en, _prefix_key)).join(
        keyed(v_crowded, text_keys(vn, _piece_keys)).hint("merge"), ["cell", "key"]
    )
    # the openings are made once a record, not once a cell
    v_around = v_crowded.withColumn("_keys", _prefix_key(vn)).withColumn("cell", around("v"))
    inner_v = keyed(e.withColumn("cell", home("e")), _piece_keys(en)).join(
        keyed(v_around, F.col("_keys")).drop("_keys").hint("merge"), ["cell", "key"]
    )
    keyed_pairs = inner_e.unionByName(inner_v).drop("cell", "key")
    return met.unionByName(keyed_pairs)


def _tiled(e: DataFrame, v: DataFrame, radius_m: float) -> tuple[DataFrame, DataFrame]:
    """Both sides with the tile where they meet: the larger one once, the other in every tile that it can reach."""
    tiles = RadiusCells(TILE * radius_m)

    def once(df: DataFrame, side: str) -> DataFrame:
        return df.withColumn("tile", tiles.home(F.col(f"{side}lat"), F.col(f"{side}lng")))

    def copied(df: DataFrame, side: str) -> DataFrame:
        return df.withColumn("tile", F.explode(tiles.touched(F.col(f"{side}lat"), F.col(f"{side}lng"), radius_m)))

    return (copied(e, "e"), once(v, "v")) if e.count() < v.count() else (once(e, "e"), copied(v, "v"))


def _in_reach(radius_m: float) -> Column:
    """True of all pairs within the radius, and cheap: told by degrees alone."""
    near, turn = radius_m / 1000.0 / KM_PER_DEGREE, F.abs(F.col("elng") - F.col("vlng"))
    narrow = F.cos(F.radians(F.least(F.abs(F.col("elat")) + F.lit(near), F.lit(90.0))))
    return (F.abs(F.col("elat") - F.col("vlat")) <= near) & (F.least(turn, F.abs(F.lit(360.0) - turn)) * narrow <= near)


def _met(e: DataFrame, v: DataFrame, radius_m: float) -> DataFrame:
    """All pairs that can be within the radius."""
    mine, theirs = _tiled(e, v, radius_m)
    return mine.join(theirs.hint("merge"), "tile").filter(_in_reach(radius_m)).drop("tile")


def _same_name(e: DataFrame, v: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of equal names that can be within the radius."""
    mine, theirs = _tiled(e, v, radius_m)
    same = (mine["tile"] == theirs["tile"]) & (mine["en"] == theirs["vn"])
    return mine.join(theirs.hint("merge"), same).filter(_in_reach(radius_m)).drop("tile")


def _attach(external: DataFrame, rule: NameRule, best: DataFrame) -> DataFrame:
    """Give every external record the match of its collapsed form."""
    keyed = external.withColumn("_n", rule(F.col("name")))
    cond = (keyed["_n"] == best["en"]) & (keyed["lat"] == best["elat"]) & (keyed["lng"] == best["elng"])
    return keyed.join(best.hint("merge"), cond, "left").drop("_n", "en", "elat", "elng")


def match_by_name_then_place(external: DataFrame, venues: DataFrame, order: str = "id", crowd: int = CROWD) -> DataFrame:
    """Adds ``match_id``: same name within 100 m; else within 50 m and one name inside the
    other or two shared words. The first venue in list order wins within each step. ``crowd``
    chooses between two ways to the same pairs, cell by cell."""
    e = _collapse(external, normalise_quotes, "ext_id", "e").drop("eord")
    v = _collapse(venues, normalise_quotes, order, "v")
    dist = haversine_m(F.col("elat"), F.col("elng"), F.col("vlat"), F.col("vlng"))
    en, vn = F.col("en"), F.col("vn")
    same = _same_name(e, v, 100.0).filter(dist < 100).select("en", "elat", "elng", F.col("vord").alias("first"))
    masked = e.withColumn("em", word_mask(en)), v.withColumn("vm", word_mask(vn))
    two_words = may_share_two(F.col("em"), F.col("vm")) & (shared_words(en, vn) >= 2)
    akin = (
        _near(*masked, 50.0, with_words=True, crowd=crowd)
        .filter((dist < 50) & (contains_either(vn, en) | two_words))
        .select("en", "elat", "elng", F.col("vord").alias("second"))
    )
    best = (
        same.unionByName(akin, allowMissingColumns=True)
        .groupBy("en", "elat", "elng")
        .agg(F.min("first").alias("first"), F.min("second").alias("second"))
        .select(
            "en", "elat", "elng", F.coalesce("first", "second").alias("match_id"),
            F.when(F.col("first").isNotNull(), 1).when(F.col("second").isNotNull(), 2).alias("match_step"),
        )
    )
    return _attach(external, normalise_quotes, best)


def match_by_place(
    external: DataFrame, venues: DataFrame, order: str = "id", threshold_m: float = 100.0, crowd: int = CROWD
) -> DataFrame:
    """Adds ``match_id``: first venue within the threshold that has the same name, a name inside
    the other or lies closer than 30 m."""
    e = _collapse(external, normalise_endings, "ext_id", "e").drop("eord")
    v = _collapse(venues, normalise_endings, order, "v")
    dist = haversine_m(F.col("elat"), F.col("elng"), F.col("vlat"), F.col("vlng"))
    by_name = (
        _near(e, v, threshold_m, with_words=False, crowd=crowd)
        .filter((dist <= threshold_m) & contains_either(F.col("vn"), F.col("en")))
        .select("en", "elat", "elng", "vord")
    )
    # closer than 30 m the name does not matter, so only distinct points meet
    spots = v.groupBy("vlat", "vlng").agg(F.min("vord").alias("vord"))
    close = RadiusCells(30.0)
    near_spots = (
        e.select("elat", "elng").distinct()
        .withColumn("cell", F.explode(close.around(F.col("elat"), F.col("elng"))))
        .join(spots.withColumn("cell", close.home(F.col("vlat"), F.col("vlng"))).hint("merge"), "cell")
        .filter(dist < min(30.0, threshold_m + 1e-9))
        .groupBy("elat", "elng")
        .agg(F.min("vord").alias("vord"))
    )
    by_spot = e.join(near_spots.hint("merge"), ["elat", "elng"]).select("en", "elat", "elng", "vord")
    best = (
        by_name.unionByName(by_spot)
        .groupBy("en", "elat", "elng")
        .agg(F.min("vord").alias("match_id"))
    )
    return _attach(external, normalise_endings, best)


def pick_verified(external: DataFrame, results: DataFrame) -> DataFrame:
    """First search result (lowest ``rank``) within 100 m whose name is inside the other or
    shares a word. ``results``: ext_id, rank, place_id, place_name, place_lat, place_lng."""
    en, pn = normalise_quotes(F.col("name")), normalise_quotes(F.col("place_name"))
    placed = (F.col("place_lat") != 0) & (F.col("place_lng") != 0)
    near = haversine_m(F.col("lat"), F.col("lng"), F.col("place_lat"), F.col("place_lng")) < 100
    return (
        external.select("ext_id", "name", "lat", "lng")
        .join(results, "ext_id")
        .filter(placed & near)
        .filter(contains_either(pn, en) | (shared_words(en, pn) >= 1))
        .groupBy("ext_id")
        .agg(F.min_by("place_id", "rank").alias("place_id"))
    )


def unmatched(matched: DataFrame) -> DataFrame:
    return matched.filter(F.col("match_id").isNull())


def priority_class(pack: CityPack, cuisine: Column) -> Column:
    return (
        F.when(cuisine.isin(pack.priority_categories), 0).when(~cuisine.isin(pack.plain_categories), 1).otherwise(2)
    )


def discover_new(external: DataFrame, venues: DataFrame, pack: CityPack, limit: int | None = None) -> DataFrame:
    """External records without a venue, without noise, interesting kitchens first; all unless limited."""
    fresh = worthwhile_candidates(unmatched(match_by_place(external, venues)), pack)
    ordered = fresh.withColumn("priority", priority_class(pack, F.col("cuisine"))).orderBy("priority", "ext_id")
    return (ordered if limit is None else ordered.limit(limit)).drop("match_id")


def not_found(candidates: DataFrame, verified: DataFrame) -> DataFrame:
    return candidates.join(verified.select("ext_id"), "ext_id", "left_anti")


# --- duplicates before insert ------------------------------------------------------------

def _box_cells(df: DataFrame, eps: float, prefix: str, spread: bool) -> DataFrame:
    y, x = F.floor(F.col("lat") / F.lit(eps)).cast("bigint"), F.floor(F.col("lng") / F.lit(eps)).cast("bigint")
    if not spread:
        return df.withColumns({"_y": y, "_x": x})
    return df.withColumn("_y", F.explode(F.sequence(y - 1, y + 1))).withColumn(
        "_x", F.explode(F.sequence(x - 1, x + 1))
    )


def _in_box(eps: float) -> Column:
    return (F.abs(F.col("lat") - F.col("lat2")) < eps) & (F.abs(F.col("lng") - F.col("lng2")) < eps)


def _others(df: DataFrame) -> DataFrame:
    return df.select(
        "k", "_y", "_x", F.col("lat").alias("lat2"), F.col("lng").alias("lng2"), F.col("ord").alias("ord2")
    )


def existing_duplicates(new: DataFrame, existing: DataFrame, eps: float = 0.001, trim: bool = False) -> DataFrame:
    """New records with an existing venue of the same name inside the box, with its first id.

    ``new`` and ``existing``: id, name, lat, lng.
    """
    key = key_name(F.col("name")) if trim else F.lower("name")
    mine = new.select(key.alias("k"), F.col("id").alias("ord"), "lat", "lng")
    points = mine.groupBy("k", "lat", "lng").agg(F.min("ord").alias("ord"))
    theirs = existing.groupBy(key.alias("k"), "lat", "lng").agg(F.min("id").alias("ord"))
    hits = (
        _box_cells(points, eps, "", spread=True)
        .join(_others(_box_cells(theirs, eps, "", spread=False)), ["k", "_y", "_x"])
        .filter(_in_box(eps))
        .groupBy("k", "lat", "lng")
        .agg(F.min("ord2").alias("existing_id"))
    )
    return mine.join(hits, ["k", "lat", "lng"]).select(F.col("ord").alias("id"), "existing_id")


def accept_new(new: DataFrame, existing: DataFrame, eps: float = 0.001, trim: bool = False) -> DataFrame:
    """Records to insert, as if tested one after the other in id order.

    A record is refused when an existing venue or an earlier accepted record has the same
    name inside the box. Copies at one point collapse to the first. Two points in one box
    cell always collide, so per round at most the first open point of each cell can be
    accepted; rounds go on until nothing is open. No round pairs all points of a cell.
    """
    spark = new.sparkSession
    ensure_checkpoint_dir(spark)
    taken = existing_duplicates(new, existing, eps, trim).select("id")
    key = key_name(F.col("name")) if trim else F.lower("name")
    fresh = new.join(taken, "id", "left_anti")
    waiting = (
        fresh.groupBy(key.alias("k"), "lat", "lng").agg(F.min("id").alias("ord")).checkpoint()
    )
    accepted = None
    while True:
        homed = _box_cells(waiting, eps, "", spread=False)
        first = homed.groupBy("k", "_y", "_x").agg(F.min(F.struct("ord", "lat", "lng")).alias("f")).select(
            "k", "f.ord", "f.lat", "f.lng"
        )
        # a first point waits for any earlier open point of the neighbour cells inside its box
        blocked = (
            _box_cells(first, eps, "", spread=True)
            .join(_others(homed), ["k", "_y", "_x"])
            .filter(_in_box(eps) & (F.col("ord2") < F.col("ord")))
            .select("ord")
            .distinct()
        )
        now = first.join(blocked, "ord", "left_anti").checkpoint()
        accepted = now if accepted is None else accepted.unionByName(now)
        covered = (
            _others(homed)
            .join(_box_cells(now, eps, "", spread=True), ["k", "_y", "_x"])
            .filter(_in_box(eps))
            .select(F.col("ord2").alias("ord"))
            .distinct()
        )
        waiting = waiting.join(covered, "ord", "left_anti").checkpoint()
        if waiting.isEmpty():
            break
    return new.join(accepted.select(F.col("ord").alias("id")), "id", "left_semi")


# --- filling attributes ---------------------------------------------------------------------

ATTRIBUTES = ["outdoor_seating", "wheelchair", "diet_vegan", "diet_vegetarian", "diet_halal"]


def fill_attributes(venues: DataFrame, matched: DataFrame, order: str = "ext_id") -> DataFrame:
    """Copy attributes of matched external records where the venue has none; the first record wins."""

    def given(c: Column) -> Column:
        return F.when(c != "", c)

    offers = (
        matched.filter("match_id is not null")
        .groupBy(F.col("match_id").alias("id"))
        .agg(
            *[
                F.min(F.when(given(F.col(a)).isNotNull(), F.struct(F.col(order), F.col(a).alias("v")))).alias(f"_{a}")
                for a in ATTRIBUTES
            ]
        )
    )
    have = set(venues.columns)
    out = venues.join(offers, "id", "left")
    filled = {
        a: F.coalesce(given(F.col(a)), F.col(f"_{a}.v")) if a in have else F.col(f"_{a}.v") for a in ATTRIBUTES
    }
    return out.withColumns(filled).drop(*[f"_{a}" for a in ATTRIBUTES])


def verified_places(found: DataFrame, known: DataFrame) -> DataFrame:
    """Verified places (id, ...) that are not in the data yet, once each, marked with their source."""
    return (
        found.join(known.select("id"), "id", "left_anti").withColumn("source", F.lit("osm_verified"))
    )
