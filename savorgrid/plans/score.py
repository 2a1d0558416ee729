"""The itemised venue score.

Everything is one projection over rows that carry their zones; the only joins are with
small lookup tables of the city pack (left equi-joins, broadcast by size) and, if given,
with mention counts and certificates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..context import CityPack
from ..functions.hours import rhythm_bonus, schedule
from ..functions.numeric import bell, clamp, confidence, sigmoid
from ..functions.rules import any_contains, flag
from ..functions.text import FRY_SHOP_WORDS, family_pattern, identity_markers
from ..operators import filters as flt
from ..operators import names as nm
from ..operators import zones as zn

# Weights of the positive parts (they sum to one) and size of the penalties.
WEIGHTS = {
    "base_quality": 0.35, "residual": 0.25, "scarcity": 0.12, "independent": 0.12,
    "community": 0.07, "local_icon": 0.05, "family_name": 0.02, "specificity": 0.01,
}
PENALTIES = {
    "tourist_trap": -0.15, "chain": -0.10, "low_review": -0.15,
    "office_bubble": -0.03, "shop": -0.80,
}
TIERS = [(0.55, "Gold"), (0.48, "Silver"), (0.30, "Bronze")]
CALM_TIERS = ["local_foodie", "diaspora_hub", "underexplored"]

COMPONENTS = [
    "review_adjustment", "base_quality", "residual_score", "tourist_penalty", "community_bonus",
    "independent_bonus", "chain_penalty", "rarity_bonus", "office_penalty", "price_quality_penalty",
    "value_bonus", "scarcity_bonus", "guide_bonus", "mention_bonus", "low_review_penalty", "family_bonus",
    "specificity_bonus", "shop_penalty", "local_icon_bonus",
]


def review_adjustment(reviews: Column, fry_type: Column, tier: Column) -> Column:
    """Saturation curve over the number of reviews."""
    n = reviews.cast("double")
    return (
        F.when(n < 25, F.lit(-0.30) * (F.lit(1.0) - sigmoid(n, 15, 0.2)))
        .when(n <= 150, F.lit(0.05) * bell(n, 75, 40))
        .when(n <= 600, F.lit(0.05) * bell(n, 300, 150))
        .when(n <= 1200, F.lit(0.02) * (F.lit(1.0) - sigmoid(n, 900, 0.005)))
        .when(fry_type, 0.0)
        .when(
            flag(tier.isin(CALM_TIERS)),
            F.greatest(F.lit(-0.10), F.lit(-0.03) * sigmoid(n, 2000, 0.001)),
        )
        .otherwise(F.greatest(F.lit(-0.20), F.lit(-0.08) * sigmoid(n, 1500, 0.002)))
    )


def is_fry_type(pack: CityPack, category: Column, name: Column) -> Column:
    words = [*FRY_SHOP_WORDS, *pack.known_fry_shops]
    return flag(category.isin("Fast Food", "Belgian") & any_contains(F.lower(name), words))


def base_quality(rating: Column, conf: Column) -> Column:
    raw = F.coalesce(rating / F.lit(5.0), F.lit(0.0))
    return F.lit(WEIGHTS["base_quality"]) * raw * (F.lit(0.5) + F.lit(0.5) * conf)


def residual_score(residual: Column, conf: Column) -> Column:
    return F.lit(WEIGHTS["residual"]) * clamp(residual * F.lit(2.0), -1.0, 1.0) * conf


def tourist_trap(
    pack: CityPack, quarter: Column, tier_of_quarter: Column, centre_km: Column, rating: Column, reviews: Column
) -> Column:
    """0 to 1: busy and mediocre inside a crowd zone."""
    zone = (
        flag(quarter.isin(pack.crowd_quarters)) | flag(tier_of_quarter == "tourist_trap") | flag(centre_km < 0.15)
    )
    busy, mediocre = flag(reviews > 1500), flag(rating < 4.3)
    return (
        F.when(~zone, 0.0)
        .when(
            busy & mediocre,
            F.least(F.lit(1.0), F.lit(0.4) + F.lit(0.3) * (F.lit(4.3) - rating)),
        )
        .when(busy, 0.15)
        .when(mediocre & flag(centre_km < 0.1), 0.2)
        .otherwise(0.0)
    )


def tourist_penalty(trap: Column, adjustment: Column) -> Column:
    """Halved where the review curve already took something off."""
    return F.lit(PENALTIES["tourist_trap"]) * trap * F.when(adjustment >= 0, 1.0).otherwise(0.5)


def language_share(languages: Column, wanted: Column) -> Column:
    """Share of the wanted languages in map<language, count>."""
    total = F.aggregate(F.map_values(languages), F.lit(0.0), lambda a, n: a + n)
    hits = F.aggregate(
        wanted, F.lit(0.0), lambda a, w: a + F.coalesce(F.try_element_at(languages, w), F.lit(0))
    )
    return F.coalesce(F.when(total > 0, hits / F.nullif(total, F.lit(0.0))), F.lit(0.0))


def community_score(affinity: Column, on_matching_street: Column, share: Column) -> Column:
    """Affinity, raised on a matching street and by reviews in the community's languages."""
    street = F.when(
        (affinity > 0) & on_matching_street, F.least(F.lit(1.0), affinity + F.lit(0.3))
    ).otherwise(affinity)
    return F.when(street > 0, F.least(F.lit(1.0), street + F.lit(0.2) * share)).otherwise(street)


def community_blocked(pack: CityPack, trap: Column, rating: Column, name: Column, address: Column) -> Column:
    place = F.lower(F.concat(name, F.lit(" "), address))
    in_hall = flag((name != "") & (address != "") & any_contains(place, pack.hall_words))
    return (trap > 0.3) | flag((rating > 0) & (rating < 3.5)) | in_hall


def community_bonus(pack: CityPack, score: Column, blocked: Column, name: Column, price: Column) -> Column:
    hip = F.when(flag(any_contains(F.lower(name), pack.hip_words)), 0.3).otherwise(1.0)
    fine = F.when(flag(price == 4), 0.2).otherwise(1.0)
    return F.when(blocked, 0.0).otherwise(F.lit(WEIGHTS["community"]) * (score * hip * fine))


def office_penalty(office_km: Column, price: Column, languages: Column | None) -> Column:
    """Dear and English-speaking places next to the office quarter."""
    dear = F.when(price >= 3, (price - 2) / F.lit(2.0)).otherwise(0.0)
    share = language_share(languages, F.array(F.lit("en"))) if languages is not None else F.lit(0.0)
    english = F.when(share > 0.7, 0.5).otherwise(0.0)
    weight = F.lit(0.4) * dear + F.lit(0.3) * english + F.lit(0.3)
    return F.when(
        office_km <= 1.0, F.lit(PENALTIES["office_bubble"]) * (F.lit(1.0) - office_km) * weight
    ).otherwise(0.0)


def price_quality_penalty(price: Column, rating: Column) -> Column:
    rated = rating > 0
    return (
        F.when(rated & (price == 4) & (rating < 4.5), F.lit(-0.10) * (F.lit(4.5) - rating))
        .when(rated & (price == 3) & (rating < 4.3), F.lit(-0.06) * (F.lit(4.3) - rating))
        .otherwise(0.0)
    )


def value_bonus(price: Column, rating: Column) -> Column:
    return (
        F.when((price == 1) & (rating >= 4.5), 0.04)
        .when((price == 1) & (rating >= 4.2), 0.02)
        .when((price == 2) & (rating >= 4.6), 0.02)
        .when((price == 2) & (rating >= 4.4), 0.01)
        .otherwise(0.0)
    )


def review_scarcity(rating: Column, reviews: Column) -> Column:
    n = reviews.cast("double")
    band = (
        F.when(n.between(50, 200), 1.0)
        .when((n > 200) & (n <= 500), 0.7)
        .when((n >= 35) & (n < 50), F.lit(0.3) + F.lit(0.6) * ((n - F.lit(35.0)) / F.lit(15.0)))
        .when((n > 500) & (n <= 1000), 0.3)
        .otherwise(0.0)
    )
    return F.when(rating >= 4.0, band).otherwise(0.0)


def scarcity(review_part: Column, rhythm: Column, rare: Column) -> Column:
    return F.lit(0.70) * review_part + F.lit(0.20) * rhythm + F.lit(0.10) * rare


def low_review_penalty(reviews: Column, rating: Column, conf: Column) -> Column:
    extreme = (
        F.when(rating == 5.0, 1.0).when(rating >= 4.8, 0.8).when(rating >= 4.5, 0.5).when(rating >= 4.0, 0.2)
        .otherwise(0.0)
    )
    return F.when(reviews >= 200, 0.0).otherwise(F.lit(PENALTIES["low_review"]) * (F.lit(1.0) - conf) * extreme)


def tier(total: Column) -> Column:
    out = None
    for floor_, label in TIERS:
        out = F.when(total >= floor_, label) if out is None else out.when(total >= floor_, label)
    return out.otherwise("Unranked")


# --- defined, but not part of the total --------------------------------------------

def visibility_boost(total_reviews: Column) -> Column:
    """More for districts with few reviews; 0.5 where the district is unknown."""
    boost = F.lit(3.0) / (F.log(total_reviews.cast("double") + F.lit(1.0)) + F.lit(1.0))
    return F.coalesce(F.least(F.lit(1.0), boost), F.lit(0.5))


def cold_start(reviews: Column, rating: Column, district_tier: Column) -> Column:
    n = reviews.cast("double")
    lift = F.greatest(F.lit(0.0), rating - F.lit(4.0))
    by_tier = F.when(flag(district_tier == "underexplored"), 1.5).otherwise(1.0)
    return F.when(n >= 50, 0.0).otherwise(lift * (F.lit(1.0) - n / F.lit(50.0)) * by_tier * F.lit(0.5))


def category_rarity(in_district: Column, district_total: Column) -> Column:
    freq = F.coalesce(in_district, F.lit(0)) / F.nullif(district_total, F.lit(0)).cast("double")
    return (
        F.when(freq.isNull(), 0.5)
        .when(freq == 0, 1.0)
        .otherwise(F.least(F.lit(1.0), F.lit(1.0) / F.nullif(freq * F.lit(10.0), F.lit(0.0))))
    )


def scarcity_quality(rating: Column, reviews: Column) -> Column:
    high, n = rating >= 4.5, reviews
    return (
        F.when((rating < 4.3) | (n < 35), 0.0)
        .when(high & n.between(50, 300), 1.0)
        .when(high & (n < 50), 0.7)
        .when(high & (n > 300) & (n <= 600), 0.6)
        .when(n.between(50, 300), 0.5)
        .otherwise(0.0)
    )


# --- the job ------------------------------------------------------------------------

def _clean(df: DataFrame, pack: CityPack) -> DataFrame:
    """One meaning of missing: no reviews is 0, no residual is 0, NaN is null."""
    kinds = dict(df.dtypes)

    def number(name: str, default) -> Column:
        if name not in kinds:
            return F.lit(default)
        col = F.col(name)
        if kinds[name] in ("double", "float"):
            col = F.when(~F.isnan(col), col)
        return F.coalesce(col, F.lit(default))

    out = {
        "review_count": number("review_count", 0).cast("bigint"),
        "residual": number("residual", 0.0),
        "price_numeric": number("price_numeric", 2).cast("int"),
        "is_chain": flt.is_chain(pack, F.col("name")),
    }
    if "opening_hours" not in kinds:
        out["opening_hours"] = F.lit(None).cast("array<string>")
    if "address" not in kinds:
        out["address"] = F.lit(None).cast("string")
    if "category" not in kinds:
        out["category"] = nm.category(pack, F.col("name"), F.col("primary_type"), F.col("types"))
    return df.withColumns(out)


def _with_facts(
    df: DataFrame, pack: CityPack, mentions: DataFrame | None, certified: DataFrame | None
) -> DataFrame:
    spark = df.sparkSession
    out = zn.with_zones(_clean(df, pack), pack)
    # the words of the known streets are worked out on the lookup table, once per category
    categories = pack.category_frame(spark).withColumn("street_words", zn.known_street_words(pack, F.col("streets")))
    out = (
        out.join(pack.affinity_frame(spark), ["category", "district"], "left")
        .join(categories, "category", "left")
        .withColumn("affinity", zn.affinity_score())
    )
    out = nm.with_guides(out, pack)
    if mentions is not None:
        out = nm.with_mentions(out, mentions)
    else:
        out = out.withColumn("reddit_mentions", F.lit(0).cast("bigint"))
    if certified is not None:
        yes = certified.select("id", F.lit(True).alias("has_certificate")).distinct()
        out = out.join(yes, "id", "left").withColumn("has_certificate", flag(F.col("has_certificate")))
    else:
        out = out.withColumn("has_certificate", F.lit(False))
    return out


def score_venues(
    df: DataFrame, pack: CityPack, mentions: DataFrame | None = None, certified: DataFrame | None = None
) -> DataFrame:
    """Adds zones, badges, ``components``, ``score`` and ``tier`` to every venue.

    Expects id, name, lat, lng, rating, review_count and primary_type; uses residual,
    price_numeric, category, opening_hours, address and review_languages (map of counts)
    where present.
    """
    f = _with_facts(df, pack, mentions, certified)
    name, rating, reviews = F.col("name"), F.col("rating"), F.col("review_count")
    price, conf = F.col("price_numeric"), F.col("confidence")
    languages = F.col("review_languages") if "review_languages" in df.columns else None
    quarter_tier = F.when(F.col("quarter").isNotNull(), F.col("area_tier"))

    f = f.withColumns(
        {
            "confidence": confidence(reviews),
            "review_adjustment": review_adjustment(
                reviews, is_fry_type(pack, F.col("category"), name), F.col("area_tier")
            ),
            "trap": F.when(
                F.col("centre_km").isNotNull(),
                tourist_trap(pack, F.col("quarter"), quarter_tier, F.col("centre_km"), rating, reviews),
            ).otherwise(0.0),
            "rhythm": rhythm_bonus(rating, schedule(F.col("opening_hours"))),
            "review_scarcity": review_scarcity(rating, reviews),
            "cuisine_scarcity": F.coalesce("rare", F.lit(0.0)),
            "family_pattern": family_pattern(name),
            "markers": identity_markers(name),
            "street_match": zn.street_fits_category(pack, F.col("street"), F.col("street_words")),
        }
    )
    share = F.lit(0.0)
    if languages is not None:
        share = F.coalesce(language_share(languages, F.col("languages")), F.lit(0.0))
    f = f.withColumns(
        {
            "community_raw": community_score(F.col("affinity"), F.col("street_match"), share),
            "community_blocked": community_blocked(pack, F.col("trap"), rating, name, F.col("address")),
        }
    )
    parts = {
        "review_adjustment": F.col("review_adjustment"),
        "base_quality": base_quality(rating, conf),
        "residual_score": residual_score(F.col("residual"), conf),
        "tourist_penalty": tourist_penalty(F.col("trap"), F.col("review_adjustment")),
        "community_bonus": community_bonus(pack, F.col("community_raw"), F.col("community_blocked"), name, price),
        "independent_bonus": F.when(F.col("is_chain"), 0.0).otherwise(WEIGHTS["independent"]),
        "chain_penalty": F.when(F.col("is_chain"), PENALTIES["chain"]).otherwise(0.0),
        "rarity_bonus": F.lit(0.0),
        "office_penalty": F.coalesce(office_penalty(F.col("office_km"), price, languages), F.lit(0.0)),
        "price_quality_penalty": price_quality_penalty(price, rating),
        "value_bonus": value_bonus(price, rating),
        "scarcity_bonus": F.lit(WEIGHTS["scarcity"])
        * scarcity(F.col("review_scarcity"), F.col("rhythm.score"), F.col("cuisine_scarcity")),
        "guide_bonus": F.lit(0.0),
        "mention_bonus": F.lit(0.0),
        "low_review_penalty": low_review_penalty(reviews, rating, conf),
        "family_bonus": F.when(
            F.col("family_pattern").isNotNull() & ~F.col("is_chain"), WEIGHTS["family_name"]
        ).otherwise(0.0),
        "specificity_bonus": F.lit(WEIGHTS["specificity"]) * F.coalesce("specificity", F.lit(0.0)),
        "shop_penalty": F.when(flt.is_shop(pack, name), PENALTIES["shop"]).otherwise(0.0),
        "local_icon_bonus": F.lit(WEIGHTS["local_icon"]) * nm.local_icon_score(pack, name, F.col("fry_score")),
    }
    f = f.withColumn("components", F.struct(*[parts[c].cast("double").alias(c) for c in COMPONENTS]))
    total = sum((F.col(f"components.{c}") for c in COMPONENTS[1:]), F.col(f"components.{COMPONENTS[0]}"))
    badge = nm.guide_bonus(F.col("michelin_stars"), F.col("bib_gourmand"), F.col("gault_millau"))
    f = f.withColumn("score", clamp(total, 0.0, 1.0)).withColumns(
        {
            "tier": tier(F.col("score")),
            "commune_tier": F.col("area_tier"),
            "diaspora_street": F.when(F.col("street_match") & (F.col("affinity") > 0) & ~F.col("community_blocked"), F.col("street")),
            "community_context": zn.community_context(F.col("streets"), F.col("community"), F.col("note")),
            "is_rare_category": F.col("cuisine_scarcity") > 0,
            "horseshoe_bonus": F.col("rhythm.score"),
            "horseshoe_type": F.col("rhythm.kind"),
            "mention_score": mention_part(),
            "badge_bonus": badge,
        }
    )
    helper = {
        "has_affinity", "community", "local", "rare", "specificity", "languages", "note", "streets", "street_words", "rhythm",
        "fry_score", "street_match", "community_blocked",
    }
    return f.drop(*helper)


def mention_part() -> Column:
    return nm.mention_score(F.col("reddit_mentions"), F.col("review_count"))


def rerank(
    df: DataFrame,
    pack: CityPack,
    closed: DataFrame,
    mentions: DataFrame | None = None,
    certified: DataFrame | None = None,
) -> DataFrame:
    """Scored venues without shops, non-food places and closed ones.

    The filters do not look at the score, so they run first and the score is only
    computed for what is kept.
    """
    kept = flt.drop_closed(flt.drop_not_food(flt.drop_shops(df, pack), pack), closed)
    return score_venues(kept, pack, mentions, certified)


def with_optional_terms(scored: DataFrame) -> DataFrame:
    """The four terms that are defined but not part of the total.

    District totals are aggregated first and joined back, so a district that holds most
    venues never has to fit into one task.
    """
    by_category = scored.groupBy("district", "category").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("review_count").alias("_r")
    )
    by_district = by_category.groupBy("district").agg(
        F.sum("_n").alias("_total"), F.sum("_r").alias("_reviews")
    )
    return (
        scored.join(by_category.drop("_r"), ["district", "category"], "left")
        .join(by_district, "district", "left")
        .withColumns(
            {
                "visibility_boost": visibility_boost(F.col("_reviews")),
                "cold_start": cold_start(F.col("review_count"), F.col("rating"), F.col("district_tier")),
                "category_rarity": category_rarity(F.col("_n"), F.col("_total")),
                "scarcity_quality": scarcity_quality(F.col("rating"), F.col("review_count")),
            }
        )
        .drop("_n", "_total", "_reviews")
    )
