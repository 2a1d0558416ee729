"""Filters, scalar rules, zones, name lookups and score components."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from savorgrid.functions import hours as hr
from savorgrid.functions import numeric as nu
from savorgrid.functions import text as tx
from savorgrid.functions.geo import haversine_km, haversine_m, in_box
from savorgrid.operators import filters as flt
from savorgrid.operators import names as nm
from savorgrid.operators import zones as zn
from savorgrid.operators.reviews import theme_counts
from savorgrid.plans import score as sc
from savorgrid.plans.features import row_features

from . import sql as S
from .registry import query, r6
from .tables import HEX, PACK, Tables

V = S.with_(S.V)
Z = S.with_(S.V, S.ZONED)
SCORED = S.with_(*S.SCORED)


def n_rows(df, *keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


# --- filters ---------------------------------------------------------------------------

@query("f01_complete_places", V + "select id from v where id % 4 <> 0 and id % 7 <> 0 and lat is not null")
def f01(t: Tables):
    df = t.venues().withColumns({
        "rating": F.expr("case when id % 4 = 0 then double('NaN') else rating end"),
        "lng": F.expr("case when id % 7 = 0 then null else lng end"),
    })
    return flt.complete_places(df).select("id")


@query("f02_in_box", V + f"select id, not ({S.OUTSIDE}) as inside from v")
def f02(t: Tables):
    return t.venues().select("id", in_box(F.col("lat").cast("string"), F.col("lng"), PACK.box).alias("inside"))


@query("f03_excluded", V + f"select id, {S.EXCLUDED} as excluded from v")
def f03(t: Tables):
    return t.venues().select("id", flt.is_excluded(PACK, F.col("name"), F.col("primary_type"), F.col("lat"), F.col("lng")).alias("excluded"))


@query("f04_chain_flag", V + f"select id, {S.CHAIN} as is_chain from v")
def f04(t: Tables):
    return t.venues().select("id", flt.is_chain(PACK, F.col("name")).alias("is_chain"))


@query("f05_drop_shops", V + f"select id from v where not {S.SHOP}")
def f05(t: Tables):
    return flt.drop_shops(t.venues(), PACK).select("id")


@query("f06_drop_not_food", V + f"select id from v where not coalesce(primary_type in {S.in_list(PACK.removed_types)}, false)")
def f06(t: Tables):
    return flt.drop_not_food(t.venues(), PACK).select("id")


def closed_names(t: Tables):
    """Names closed for good: two listed ones and every cheap new ring."""
    listed = F.lower("name").isin(PACK.closed_names) | (F.col("size") == 50)
    return t.venues().filter(listed).select(F.lower("name").alias("closed_name")).distinct()


CLOSED = f"(select lower(name) from v where lower(name) in {S.in_list(PACK.closed_names)} or size = 50)"


@query("f07_drop_closed", V + f"select id from v where lower(name) not in {CLOSED}")
def f07(t: Tables):
    return flt.drop_closed(t.venues(), closed_names(t)).select("id")


def zoned(t: Tables):
    z = zn.with_zones(t.venues(), PACK)
    return z.withColumns({
        "category": nm.category(PACK, F.col("name"), F.col("primary_type"), F.col("types")),
        "is_chain": flt.is_chain(PACK, F.col("name")),
        "venue_type": nm.venue_type(F.col("name"), F.col("primary_type"), F.col("types")),
        "price_numeric": F.lit(2),
    })


@query("f08_query_filters", Z + "select id from zoned where rating >= 3.5 and rating <= 4.8 and review_count >= 40 and category = 'Cafe' and area_tier is not null")
def f08(t: Tables):
    f = flt.VenueFilter(min_rating=3.5, max_rating=4.8, min_reviews=40, category="Cafe", district="all", tier=None)
    return f.before_top(zoned(t), PACK).select("id")


@query("f09_community_filter", Z + f"select id from zoned where category in {S.in_list(PACK.community_categories)}")
def f09(t: Tables):
    return flt.VenueFilter(community_only=True).before_top(zoned(t), PACK).select("id")


@query("f10_name_search", V + "select id from v where regexp_matches(lower(name), 'blue (gear|ring)') ")
def f10(t: Tables):
    return flt.search_names(t.venues(), "Blue (gear|ring)").select("id")


@query("f10_name_search_plain", V + "select id, name from v where contains(lower(name), 'gear econ')")
def f10b(t: Tables):
    return flt.search_names(t.venues(), "Gear Econ", regex=False).select("id", "name")


@query("f11_badge_filters", V + f"select id, {S.STARS} > 0 or {S.BIB} or {S.GUIDE} as any_guide, {S.STARS} > 0 as michelin, {S.BIB} as bib from v")
def f11(t: Tables):
    b = nm.with_guides(t.venues(), PACK)
    return b.select("id", flt.GUIDE_TESTS["any_guide"]().alias("any_guide"), flt.GUIDE_TESTS["michelin"]().alias("michelin"), flt.GUIDE_TESTS["bib"]().alias("bib"))


@query("f12_open_on_day", V + """select id from v where opening_hours is null or
  not contains(list_filter(opening_hours, lambda h: starts_with(h, 'Sunday'))[1], 'Closed')""")
def f12(t: Tables):
    return t.venues().filter(hr.open_on(F.col("opening_hours"), "Sunday")).select("id")


@query("f13_missing_ratings", V + "select id from v where id % 5 = 0 or review_count = 0")
def f13(t: Tables):
    return flt.missing_ratings(t.venues().withColumn("rating", F.expr("case when id % 5 = 0 then 0D else rating end"))).select("id")


@query("f14_candidate_noise", S.with_(S.V, S.EXTERNAL) + f"""select ext_id from ext where not {S.any_contains('lower(name)', PACK.candidate_skip_words)}
  and not (amenity = 'fast_food' and {S.osm_category('cuisine_tag')} in {S.in_list(PACK.fast_food_categories)})""")
def f14(t: Tables):
    from savorgrid.operators.ingest import osm_category

    e = t.external().withColumn("cuisine", osm_category(F.col("cuisine_tag")))
    return flt.worthwhile_candidates(e, PACK).select("ext_id")


# --- scalar rules -------------------------------------------------------------------------

@query("x01_category", V + f"select {S.CATEGORY} as category, count(*) as n from v group by 1")
def x01(t: Tables):
    return n_rows(t.venues(), nm.category(PACK, F.col("name"), F.col("primary_type"), F.col("types")).alias("category"))


@query("x02_venue_type", V + f"select {S.VENUE_TYPE} as venue_type, count(*) as n from v group by 1")
def x02(t: Tables):
    return n_rows(t.venues(), nm.venue_type(F.col("name"), F.col("primary_type"), F.col("types")).alias("venue_type"))


@query("x03_name_normalisers", V + f"select id, {S.norm_quotes('name')} as quotes, {S.norm_endings('name')} as endings, {S.norm_company('name')} as company, {S.norm_words('name')} as words from v")
def x03(t: Tables):
    return t.venues().select("id", tx.normalise_quotes(F.col("name")).alias("quotes"), tx.normalise_endings(F.col("name")).alias("endings"),
                             tx.normalise_company(F.col("name")).alias("company"), tx.normalise_words(F.col("name")).alias("words"))


def _fold(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, {S.q(a)}, {S.q(b)})"
    return x


def _x04() -> str:
    from savorgrid.functions import address as ad

    reg = S.squeeze("regexp_replace(" + _fold("trim(lower(coalesce(address, '')))", ad.REGISTER_STREET_WORDS) + f", '{S._NOT_WORD}', '', 'g')")
    pl = _fold("lower(coalesce(address, ''))", ad.PRICE_LIST_STREET_WORDS)
    pl = S.squeeze(f"regexp_replace(regexp_replace({pl}, '\\b\\d{{4}}\\b', '', 'g'), '{S._NOT_WORD}', ' ', 'g')")
    return V + f"select id, {reg} as register_form, {pl} as price_form from v"


@query("x04_address_normalisers", _x04())
def x04(t: Tables):
    from savorgrid.functions import address as ad

    a = F.col("address")
    return t.venues().select("id", ad.normalise_register_street(a).alias("register_form"), ad.normalise_price_address(a).alias("price_form"))


@query("x05_plain_name", V + "select id, trim(lower(strip_accents(name))) as plain from v")
def x05(t: Tables):
    return t.venues().select("id", tx.plain_name(F.col("name")).alias("plain"))


@query("x06_name_similarity")
def x06(t: Tables):
    """Nearest venue name by similarity for every supplier's price entry."""
    from savorgrid.operators.fuzzy import nearest_name

    return nearest_name(t.venues(), t.price_list()).withColumn("match_score", r6("match_score"))


_LANG = "case when text is null or text = '' then 'unknown' when regexp_matches(text, '[\\x{0600}-\\x{06FF}]') then 'ar' " + " ".join(
    f"when {S.any_contains('lower(text)', cues)} then {S.q(lang)}" for lang, cues in tx.LANGUAGE_CUES) + " else 'other' end"


@query("x07_language_guess", f"select doc_id, {_LANG} as lang from documents")
def x07(t: Tables):
    return t.raw("documents").select("doc_id", tx.guess_language(F.col("text")).alias("lang"))


def _best_letters(groups) -> str:
    n = [f"len(list_intersect(list_distinct(string_split(lower(name), '')), {S.lst(dict.fromkeys(s))}))" for _, s in groups]
    top = f"greatest({', '.join(n)})"
    return f"(case when {top} = 0 then null " + " ".join(f"when {c} = {top} then {S.q(lab)}" for c, (lab, _) in zip(n, groups)) + " end)"


_EVERY = S.lst(dict.fromkeys("".join(s for _, s in tx.UNIQUE_LETTERS + tx.HINT_LETTERS)))
_HAS_LETTER = f"(list_has_any(string_split(name, ''), {_EVERY}) or list_has_any(string_split(lower(name), ''), {_EVERY}))"
_LETTER_CAT = f"case when {_HAS_LETTER} then coalesce({_best_letters(tx.UNIQUE_LETTERS)}, {_best_letters(tx.HINT_LETTERS)}) end"


@query("x08_letter_markers", V + f"select id, {_HAS_LETTER} as has_diacritics, {_LETTER_CAT} as category from v")
def x08(t: Tables):
    m = tx.letter_marker(F.col("name"))
    return t.venues().select("id", m["has"].alias("has_diacritics"), m["category"].alias("category"))


_FLAG = S.first_contains("name", [(lab, [sign]) for sign, lab in tx.FLAG_SIGNS.items()])


@query("x09_flag_markers", V + f"select id, {_FLAG} is not null as has_flag, {_FLAG} as flag_category, (case when {_HAS_LETTER} then 0.5::double else 0.0::double end) + (case when {_FLAG} is not null then 0.5::double else 0.0::double end) as signal from v")
def x09(t: Tables):
    m = tx.identity_markers(F.col("name"))
    return t.venues().select("id", m["has_flag"].alias("has_flag"), m["flag_category"].alias("flag_category"), m["signal_score"].alias("signal"))


@query("x10_family_names", V + f"select id, {S.FAMILY} as pattern from v")
def x10(t: Tables):
    return t.venues().select("id", tx.family_pattern(F.col("name")).alias("pattern"))


@query("x11_fry_shops", V + f"select id, {S.FRY} as is_fry_shop from v")
def x11(t: Tables):
    return t.venues().select("id", tx.is_fry_shop(F.col("name")).alias("is_fry_shop"))


_UNCERTAIN = f"""(case when length(name) > 80 then 0.3::double when length(name) > 60 then 0.15::double else 0 end
  + case when contains(name, '|') then 0.25::double else 0 end
  + case when (length(name) - length(replace(name, ' - ', ''))) / 3 >= 2 then 0.08::double else 0 end
  + case when {S.any_contains('lower(name)', tx.PROMO_WORDS)} then 0.08::double else 0 end
  + case when rating = 5.0 and review_count > 200 then 0.4::double when rating = 5.0 and review_count > 100 then 0.15::double else 0 end
  + case when review_count > 15000 then 0.35::double when review_count > 10000 then 0.2::double else 0 end
  + case when rating >= 4.8 and review_count > 8000 then 0.25::double else 0 end)"""


@query("x12_reputation_uncertainty", V + f"select id, {S.r6(f'least(1.0::double, {_UNCERTAIN})')} as score from (select * replace (review_count * 6 as review_count) from v) v")
def x12(t: Tables):
    u = tx.reputation_uncertainty(F.col("name"), F.col("rating"), F.col("review_count") * 6)
    return t.venues().select("id", r6(u["score"]).alias("score"))


# the driver's prose holds none of the kitchen words, so two themes of frequent tokens join them
THEMES = {**PACK.review_themes, "tokens_a": ["tion", "sche"], "tokens_b": ["ment ", "ando"]}


@query("x13_review_themes", "select n_chars % 97 as venue_id, " + ", ".join(
    f"count(*) filter (where {S.any_contains('lower(text)', ws)}) as {k}" for k, ws in THEMES.items()) + " from documents group by 1")
def x13(t: Tables):
    return theme_counts(t.doc_reviews(), THEMES)


@query("x14_weekday_close", S.with_(S.V, S.PERIODS) + "select v.id, coalesce(hour < 22 and hour > 12, false) as early, hour from v left join close_median using (id)")
def x14(t: Tables):
    c = hr.weekday_close(F.col("closing_times"))
    return t.places().select("id", c["early"].alias("early"), c["hour"].alias("hour"))


@query("x15_day_profile", S.with_(S.V, S.PERIODS) + """select v.id, len(days)::int as days_open_count,
  coalesce(not list_contains(days, 6) and not list_contains(days, 0), false) as closed_weekends,
  coalesce(list_contains(days, 6) and not list_contains(days, 0), false) as closed_sunday,
  coalesce(len(list_filter(days, lambda d: d not in (1, 2, 3, 4, 5))) = 0, false) as weekdays_only from v left join open_days using (id)""")
def x15(t: Tables):
    p = hr.day_profile(F.col("days_open"))
    return t.places().select("id", *[p[c].alias(c) for c in ("days_open_count", "closed_weekends", "closed_sunday", "weekdays_only")])


@query("x16_schedule", S.with_(S.V, S.SCHEDULE) + "select * from schedule")
def x16(t: Tables):
    s = hr.schedule(F.col("opening_hours"))
    cols = ("days_open", "total_hours_per_week", "latest_close_hour", "has_split_service", "closes_late", "is_lunch_only", "parsed")
    return t.venues().withColumn("s", s).select("id", *[F.col(f"s.{c}").alias(c) for c in cols])


@query("x17_rhythm_bonus", S.with_(S.V, S.SCHEDULE) + "select id, rhythm_score as score, rhythm_kind as kind from rhythm")
def x17(t: Tables):
    b = hr.rhythm_bonus(F.col("rating"), hr.schedule(F.col("opening_hours")))
    return t.venues().withColumn("b", b).select("id", "b.score", "b.kind")


@query("x18_haversine", V + f"select id, {S.r6(S.hav('lat', 'lng', S.q(PACK.centre[0]), S.q(PACK.centre[1])))} as km, round(1000 * {S.hav('lat', 'lng', S.q(PACK.office_hub[0]), S.q(PACK.office_hub[1]))}, 3) as m from v")
def x18(t: Tables):
    lat, lng = F.col("lat"), F.col("lng")
    return t.venues().select("id", r6(haversine_km(lat, lng, *PACK.centre)).alias("km"), F.round(haversine_m(lat, lng, *PACK.office_hub), 3).alias("m"))


_S3 = S.q(HEX.edge_km * 3 ** 0.5)


def _latlng(x: str, y: str) -> tuple[str, str]:
    import math

    return (f"{S.q(HEX.lat0)} + degrees(({y}) / 6371.0::double)", f"{S.q(HEX.lng0)} + degrees(({x}) / {S.q(6371.0 * math.cos(math.radians(HEX.lat0)))})")


HEX_X, HEX_Y = f"{_S3} * (hq + hr / 2.0::double)", f"{S.q(HEX.edge_km * 1.5)} * hr"
AXIAL = "(cell // 2097152 - 1048576) as hq, (cell % 2097152 - 1048576) as hr"


@query("x19_hex_cells", S.with_(S.V, f"h as ({S.hex_cell('v', 'id, lat, lng')})") + f"select id, cell, {S.r6(_latlng(HEX_X, HEX_Y)[0])} as hex_lat, {S.r6(_latlng(HEX_X, HEX_Y)[1])} as hex_lng, 6 as corners from (select *, {AXIAL} from h)")
def x19(t: Tables):
    df = t.venues().select("id", HEX.cell(F.col("lat"), F.col("lng")).alias("cell"))
    c = HEX.centre(F.col("cell"))
    return df.select("id", "cell", r6(c["lat"]).alias("hex_lat"), r6(c["lng"]).alias("hex_lng"), F.size(HEX.boundary(F.col("cell"))).alias("corners"))


@query("x20_confidence_curves", V + f"""select id, {S.r6(S.CONF)} as confidence, {S.r6(S.sig('rating', 4.3, 2.0))} as sigmoid,
  {S.r6(S.sig('review_count', 300.0, 4.0 / (300.0 * 0.2)))} as soft, {S.r6('case when rating > 0 then rating / (rating + residual * (residual > 0)::int) end')} as rating_weight,
  {S.r6('case when residual > 0 then residual / (rating + residual) else residual end')} as residual_weight from v""")
def x20(t: Tables):
    w = nu.normalised_weights(F.create_map(F.lit("rating"), F.col("rating"), F.lit("residual"), F.col("residual")))
    return t.venues().select("id", r6(nu.confidence(F.col("review_count"))).alias("confidence"), r6(nu.sigmoid(F.col("rating"), 4.3, 2.0)).alias("sigmoid"),
                             r6(nu.soft_threshold(F.col("review_count"), 300.0)).alias("soft"),
                             r6(w["rating"]).alias("rating_weight"), r6(w["residual"]).alias("residual_weight"))


@query("x21_log_reviews", V + f"select id, {S.r6('ln(1 + review_count)')} as log_review_count from v")
def x21(t: Tables):
    return t.venues().select("id", r6(nu.log_reviews(F.col("review_count"))).alias("log_review_count"))


_P = "((greatest(1.01::double, least(4.99::double, rating)) - 1) / 4)"


@query("x22_rating_logit", V + f"select id, {S.r6(f'ln({_P} / (1 - {_P}))')} as logit, {S.r6('greatest(1.01::double, least(4.99::double, rating))')} as back from v")
def x22(t: Tables):
    z = nu.rating_to_logit(F.col("rating"))
    return t.venues().select("id", r6(z).alias("logit"), r6(nu.logit_to_rating(z)).alias("back"))


# --- zones and name lookups ------------------------------------------------------------

@query("j02_nearest_district", Z + f"select id, district, {S.r6('district_km')} as km from near_district")
def j02(t: Tables):
    d = zn.nearest_district(PACK, F.col("lat"), F.col("lng"))
    return t.venues().withColumn("d", d).select("id", "d.district", r6(haversine_km(F.col("lat"), F.col("lng"), F.col("d.lat"), F.col("d.lng"))).alias("km"))


@query("j02_nearest_zone_large", S.with_(S.V) + f"""select id, name, {S.r6('dist')} as km from (
  select v.id, z.s_name as name, {S.hav('v.lat', 'v.lng', 'z.zlat', 'z.zlng')} as dist,
    row_number() over (partition by v.id order by {S.hav('v.lat', 'v.lng', 'z.zlat', 'z.zlng')}, z.s_suppkey) as rn
  from v, (select s_suppkey, s_name, 50.0::double + ((s_suppkey * 7919) % 1500) / 1000.0::double as zlat,
                  3.5::double + ((s_suppkey * 104729) % 2200) / 1000.0::double as zlng from supplier) z) where rn = 1""")
def j02b(t: Tables):
    return zn.nearest_zone(t.venues(), supplier_zones(t)).select("id", "zone.name", r6("zone.dist").alias("km"))


def supplier_zones(t: Tables):
    """A zone table that grows with the data: one circle per supplier."""
    return t.raw("supplier").selectExpr(
        "s_suppkey as ord", "s_name as name", "50.0D + ((s_suppkey * 7919) % 1500) / 1000.0D as lat",
        "3.5D + ((s_suppkey * 104729) % 2200) / 1000.0D as lng", "3.0D + (s_suppkey % 9) as radius",
    )


@query("j03_containing_quarter", Z + "select v.id, k.quarter, k.quarter_tier as tier from v left join in_quarter k using (id)")
def j03(t: Tables):
    k = zn.containing_quarter(PACK, F.col("lat"), F.col("lng"))
    return t.venues().withColumn("k", k).select("id", "k.quarter", "k.tier")


@query("j03_containing_zone_large", S.with_(S.V) + f"""select v.id, arg_min(z.s_name, z.s_suppkey) as name
  from v left join (select s_suppkey, s_name, 50.0::double + ((s_suppkey * 7919) % 1500) / 1000.0::double as zlat,
      3.5::double + ((s_suppkey * 104729) % 2200) / 1000.0::double as zlng, 3.0::double + (s_suppkey % 9) as radius from supplier) z
    on {S.hav('v.lat', 'v.lng', 'z.zlat', 'z.zlng')} < z.radius group by v.id""")
def j03b(t: Tables):
    return zn.containing_zone(t.venues(), supplier_zones(t), 11.0).select("id", "zone.name")


@query("j04_on_street", Z + "select v.id, s.street from v left join on_street s using (id)")
def j04(t: Tables):
    return t.venues().select("id", zn.on_street(PACK, F.col("lat"), F.col("lng")).alias("street"))


AFF = S.with_(S.V, S.ZONED, S.AFFINE)


@query("j05_affinity", AFF + f"select id, {S.r6('affinity')} as affinity from affine")
def j05(t: Tables):
    out = zn.with_affinity(zoned(t), PACK.affinity_frame(t.spark), PACK.category_frame(t.spark))
    return out.select("id", r6("affinity").alias("affinity"))


@query("j06_street_fits_category", AFF + "select id, street_match as fits from affine")
def j06(t: Tables):
    words = PACK.category_frame(t.spark).select("category", zn.known_street_words(PACK, F.col("streets")).alias("words"))
    out = zoned(t).join(words, "category", "left")
    return out.select("id", zn.street_fits_category(PACK, F.col("street"), F.col("words")).alias("fits"))


_CTX = f"""select id, in_area, note, coalesce(array_to_string(labels[1:3], '|'), '') as streets from (
  select a.id, coalesce(any_value(a.community) >= 0.7, false) as in_area, any_value(a.note) as note,
    list(label order by ord) filter (where label is not null) as labels
  from affine a left join (select a.id, c.ord, case when c.district = a.district then c.street_name
      when {S.hav('a.lat', 'a.lng', 'c.lat', 'c.lng')} < 1.0 then c.street_name || ' (' || c.district || ')' end as label
    from affine a join cat_streets c on c.category = a.category) l using (id) group by a.id)"""


@query("j07_community_context", AFF + _CTX)
def j07(t: Tables):
    spark = t.spark
    out = zoned(t).join(PACK.affinity_frame(spark), ["category", "district"], "left").join(PACK.category_frame(spark), "category", "left")
    out = out.withColumn("c", zn.community_context(F.col("streets"), F.col("community"), F.col("note")))
    return out.select("id", "c.in_area", F.col("c.note").alias("note"), F.array_join("c.streets", "|").alias("streets"))


_MENTIONS = "mentions as (select trim(lower(name)) as key, arg_max(id % 12, id) as mentions from v group by 1)"


def mention_table(t: Tables):
    from savorgrid.sources.readers import mention_lookup

    return mention_lookup(t.venues().select("name", F.expr("id % 12").alias("reddit_mentions"), "id"), "id")


@query("j08_mentions", S.with_(S.V, _MENTIONS) + "select id, coalesce(mentions, 0) as reddit_mentions from v left join mentions on key = trim(lower(name))")
def j08(t: Tables):
    return nm.with_mentions(t.venues(), mention_table(t)).select("id", "reddit_mentions")


_GUIDES = V + f"select id, {S.STARS} as michelin_stars, {S.BIB} as bib_gourmand, {S.GUIDE} as gault_millau from v"


@query("j09_guide_phrases", _GUIDES)
def j09(t: Tables):
    return nm.with_guides(t.venues(), PACK).select("id", "michelin_stars", "bib_gourmand", "gault_millau")


@query("j09_guide_phrases_large", _GUIDES)
def j09b(t: Tables):
    # more names than any venue has change nothing
    longer = replace(PACK, bib_names=[*PACK.bib_names, *[f"unlisted {i}" for i in range(500)]])
    return nm.with_guides(t.venues(), longer).select("id", "michelin_stars", "bib_gourmand", "gault_millau")


@query("j10_institutions", V + f"select id, {S.INSTITUTION} as score from v")
def j10(t: Tables):
    return t.venues().select("id", nm.institution_score(PACK, F.col("name")).alias("score"))


# --- score components -----------------------------------------------------------------------

def scored(t: Tables):
    from savorgrid.functions.money import price_number

    v = t.venues().withColumn("price_numeric", price_number(F.col("price_level")))
    return sc.score_venues(v, PACK, mentions=mention_table(t))


def part(name: str) -> Column:
    return r6(f"components.{name}").alias(name)


@query("c01_area_tier", Z + "select id, area_tier from zoned")
def c01(t: Tables):
    return zoned(t).select("id", "area_tier")


def component(key: str, *names: str):
    cols = ", ".join(f"{S.r6('c_' + n)} as {n}" for n in names)
    query(key, SCORED + f"select id, {cols} from scored")(lambda t: scored(t).select("id", *[part(n) for n in names]))


component("c02_review_adjustment", "review_adjustment")
component("c03_base_quality", "base_quality")
component("c04_residual", "residual_score")
component("c05_tourist_trap", "tourist_penalty")
component("c06_community_bonus", "community_bonus")
component("c07_independent_chain", "independent_bonus", "chain_penalty")
component("c08_office_bubble", "office_penalty")
component("c09_price_quality", "price_quality_penalty")
component("c10_value_bonus", "value_bonus")
component("c11_scarcity", "scarcity_bonus")
component("c12_low_review", "low_review_penalty")
component("c13_family_name", "family_bonus")
component("c14_specificity", "specificity_bonus")
component("c15_shop_penalty", "shop_penalty")
component("c16_local_icon", "local_icon_bonus")


@query("c17_guide_badges", V + f"""select id, case when {S.STARS} >= 2 then 0.08::double when {S.STARS} = 1 then 0.06::double
  when {S.BIB} then 0.04::double when {S.GUIDE} then 0.03::double else 0.0::double end as badge_bonus from v""")
def c17(t: Tables):
    return scored(t).select("id", "badge_bonus")


@query("c18_mention_score", S.with_(S.V, _MENTIONS) + """select id, least(1.0::double, (case when m >= 10 then 1.0::double when m >= 5 then 0.8::double
  when m >= 3 then 0.6::double when m >= 2 then 0.4::double when m >= 1 then 0.2::double else 0.0::double end)
  * (case when review_count > 0 and review_count < 200 then 1.2::double when review_count > 2000 then 0.7::double else 1.0::double end)) as mention_score
  from (select v.*, coalesce(mentions, 0) as m from v left join mentions on key = trim(lower(name)))""")
def c18(t: Tables):
    return scored(t).select("id", "mention_score")


@query("c19_certificates")
def c19(t: Tables):
    """Venues with a certificate, from the fuzzy register match."""
    from savorgrid.operators.fuzzy import certified, match_register

    return sc.score_venues(t.venues(), PACK, certified=certified(match_register(t.venues(), t.register()))).select("id", "has_certificate")


@query("c20_score_and_tier", SCORED + f"select id, {S.r6('score')} as score, tier from scored")
def c20(t: Tables):
    return scored(t).select("id", r6("score").alias("score"), "tier")


@query("c21_rarity", SCORED + "select id, rare > 0 as is_rare_category, 0.0::double as rarity_bonus from scored")
def c21(t: Tables):
    return scored(t).select("id", "is_rare_category", part("rarity_bonus"))


_OPT = SCORED + """, totals_d as (select district, sum(review_count) as reviews, count(*) as total from scored group by 1),
 counts_d as (select district, category, count(*) as n from scored group by 1, 2) """


@query("c22_visibility_boost", _OPT + f"select id, {S.r6('least(1.0::double, 3.0::double / (ln(reviews + 1) + 1))')} as visibility_boost from scored join totals_d using (district)")
def c22(t: Tables):
    return sc.with_optional_terms(scored(t)).select("id", r6("visibility_boost").alias("visibility_boost"))


@query("c23_cold_start", SCORED + f"""select id, {S.r6("case when review_count >= 50 then 0.0::double else greatest(0.0::double, rating - 4.0) * (1 - review_count / 50.0::double) * (case when district_tier = 'underexplored' then 1.5::double else 1.0::double end) * 0.5::double end")} as cold_start from scored""")
def c23(t: Tables):
    return sc.with_optional_terms(scored(t)).select("id", r6("cold_start").alias("cold_start"))


@query("c24_category_rarity", _OPT + f"select id, {S.r6('least(1.0::double, 1.0::double / ((n / total::double) * 10))')} as category_rarity from scored join totals_d using (district) join counts_d using (district, category)")
def c24(t: Tables):
    return sc.with_optional_terms(scored(t)).select("id", r6("category_rarity").alias("category_rarity"))


@query("c25_scarcity_quality", V + """select id, case when rating < 4.3::double or review_count < 35 then 0.0::double
  when rating >= 4.5 and review_count between 50 and 300 then 1.0::double when rating >= 4.5 and review_count < 50 then 0.7::double
  when rating >= 4.5 and review_count > 300 and review_count <= 600 then 0.6::double when review_count between 50 and 300 then 0.5::double
  else 0.0::double end as scarcity_quality from v""")
def c25(t: Tables):
    return t.venues().select("id", sc.scarcity_quality(F.col("rating"), F.col("review_count")).alias("scarcity_quality"))


def featured(t: Tables):
    from savorgrid.operators.cells import add_cell_features

    return add_cell_features(row_features(t.places(), PACK, HEX))
