"""Matching, aggregates, rankings, models, composed queries and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from savorgrid.functions import numeric as nu
from savorgrid.functions.money import price_number
from savorgrid.operators import cells as ce
from savorgrid.operators import fuzzy as fz
from savorgrid.operators import ranking as rk
from savorgrid.operators import reconcile as rc
from savorgrid.operators import reports as rp
from savorgrid.operators import reviews as rv
from savorgrid.operators.filters import VenueFilter
from savorgrid.plans import api
from savorgrid.plans import model as md
from savorgrid.plans import score as sc
from savorgrid.streaming import reviews as st_rev
from savorgrid.streaming import traffic as tr

from . import expressions as X
from . import sql as S
from .q_rules import CLOSED, HEX_X, HEX_Y, AXIAL, _latlng, closed_names, featured, scored, zoned
from .registry import query, r6, scratch
from .tables import HEX, PACK, Tables

V = S.with_(S.V)
EXT = S.with_(S.V, S.EXTERNAL)
SCORED = S.with_(*S.SCORED)
FEAT = S.with_(S.V, S.CLEAN, S.FEATURED, S.CELLS)

# --- reconciliation -------------------------------------------------------------------

_D = f"1000 * {S.hav('e.lat', 'e.lng', 'v.lat', 'v.lng')}"
_QE, _QV = S.norm_quotes("e.name"), S.norm_quotes("v.name")
_NE, _NV = S.norm_endings("e.name"), S.norm_endings("v.name")


def _shared(a: str, b: str) -> str:
    return f"len(list_intersect(list_distinct(string_split({a}, ' ')), list_distinct(string_split({b}, ' '))))"


_PAIRS_A = f"""pairs as (select e.ext_id, v.id as vid, {_D} as dist, e.nn as en, v.nn as vn
  from (select *, {S.norm_quotes('name')} as nn from ext) e join (select *, {S.norm_quotes('name')} as nn from v) v
  on abs(e.lat - v.lat) < 0.001 and abs(e.lng - v.lng) < 0.0016),
 hits as (select ext_id, min(vid) filter (where en = vn and dist < 100) as first_pass,
   min(vid) filter (where dist < 50 and (contains(vn, en) or contains(en, vn) or {_shared('en', 'vn')} >= 2)) as second_pass from pairs group by 1)"""
_PAIRS_B = f"""pairs as (select e.ext_id, v.id as vid, {_D} as dist, e.nn as en, v.nn as vn
  from (select *, {S.norm_endings('name')} as nn from ext) e join (select *, {S.norm_endings('name')} as nn from v) v
  on abs(e.lat - v.lat) < 0.001 and abs(e.lng - v.lng) < 0.0016),
 hits as (select ext_id, min(vid) as match_id from pairs
   where dist <= 100 and (contains(vn, en) or contains(en, vn) or dist < 30) group by 1)"""


@query("j11_match_name_then_place", S.with_(S.V, S.EXTERNAL, _PAIRS_A) + """select ext_id, coalesce(first_pass, second_pass) as match_id,
  (case when first_pass is not null then 1 when second_pass is not null then 2 end)::int as match_step from ext left join hits using (ext_id)""")
def j11(t: Tables):
    return rc.match_by_name_then_place(t.external(), t.venues()).select("ext_id", "match_id", "match_step")


@query("j12_match_place", S.with_(S.V, S.EXTERNAL, _PAIRS_B) + "select ext_id, match_id from ext left join hits using (ext_id)")
def j12(t: Tables):
    return rc.match_by_place(t.external(), t.venues()).select("ext_id", "match_id")


def search_results(t: Tables):
    """Three search results per external record: the venue, its neighbour by number, and itself renamed."""
    v = t.venues().select("id", "name", "lat", "lng")
    first = v.select((F.col("id") + 1000000).alias("ext_id"), F.lit(2).alias("rank"), F.col("id").alias("place_id"),
                     F.col("name").alias("place_name"), F.col("lat").alias("place_lat"), F.col("lng").alias("place_lng"))
    other = first.withColumns({"rank": F.lit(1), "place_id": F.col("place_id") + 500000, "place_name": F.concat(F.lit("Corner "), F.col("place_name")),
                               "place_lat": F.col("place_lat") + F.expr("(place_id % 5) * 0.0004D")})
    return first.unionByName(other)


_RESULTS = """results as (select id + 1000000 as ext_id, 2 as rank, id as place_id, name as place_name, lat as place_lat, lng as place_lng from v
  union all select id + 1000000, 1, id + 500000, 'Corner ' || name, lat + (id % 5) * 0.0004::double, lng from v)"""


@query("j13_pick_verified", S.with_(S.V, S.EXTERNAL, _RESULTS) + f"""select ext_id, arg_min(place_id, rank) as place_id from (
  select e.ext_id, place_id, rank, {S.norm_quotes('e.name')} as en, {S.norm_quotes('place_name')} as pn,
   1000 * {S.hav('e.lat', 'e.lng', 'place_lat', 'place_lng')} as dist from ext e join results using (ext_id))
  where dist < 100 and (contains(pn, en) or contains(en, pn) or {_shared('en', 'pn')} >= 1) group by 1""")
def j13(t: Tables):
    return rc.pick_verified(t.external(), search_results(t))


_CLASS = f"case when cuisine in {S.in_list(PACK.priority_categories)} then 0 when cuisine not in {S.in_list(PACK.plain_categories)} then 1 else 2 end"


def ext_with_cuisine(t: Tables):
    from savorgrid.operators.ingest import osm_category

    return t.external().withColumn("cuisine", osm_category(F.col("cuisine_tag")))


@query("j14_discover_new", S.with_(S.V, S.EXTERNAL, _PAIRS_B) + f"""select ext_id, name, {_CLASS} as priority from (
  select *, {S.osm_category('cuisine_tag')} as cuisine from ext left join hits using (ext_id)) where match_id is null
  and not {S.any_contains('lower(name)', PACK.candidate_skip_words)} and not (amenity = 'fast_food' and cuisine in {S.in_list(PACK.fast_food_categories)})
  """)
def j14(t: Tables):
    return rc.discover_new(ext_with_cuisine(t), t.venues(), PACK).select("ext_id", "name", "priority")


@query("j14_not_found", S.with_(S.V, S.EXTERNAL, _RESULTS) + f"""select ext_id from ext where ext_id not in (
  select ext_id from (select e.ext_id, {S.norm_quotes('e.name')} as en, {S.norm_quotes('place_name')} as pn,
   1000 * {S.hav('e.lat', 'e.lng', 'place_lat', 'place_lng')} as dist from ext e join results using (ext_id))
  where dist < 100 and (contains(pn, en) or contains(en, pn) or {_shared('en', 'pn')} >= 1))""")
def j14b(t: Tables):
    e = t.external()
    return rc.not_found(e, rc.pick_verified(e, search_results(t))).select("ext_id")


def insert_batches(t: Tables):
    """Batch of all venues under their plain part name, squeezed so that many boxes touch."""
    rows = t.venues().selectExpr("id", "btype as name", "50.8D + (lat - 50.8D) * 0.2D as lat", "4.35D + (lng - 4.35D) * 0.2D as lng")
    return rows


_BATCH = """batch as (select id, btype as name, 50.8::double + (lat - 50.8::double) * 0.2::double as lat, 4.35::double + (lng - 4.35::double) * 0.2::double as lng from v),
 known as (select s_suppkey as id, btype as name, 50.8::double + (lat - 50.8::double) * 0.2::double + 0.0004::double as lat,
   4.35::double + (lng - 4.35::double) * 0.2::double as lng from supplier join v on v.id = s_suppkey)"""


def known_batch(t: Tables):
    s = t.raw("supplier").select(F.col("s_suppkey").alias("id"))
    return insert_batches(t).join(s, "id").withColumn("lat", F.col("lat") + F.lit(0.0004))


@query("j15_existing_duplicates", S.with_(S.V, _BATCH) + """select b.id, min(k.id) as existing_id from batch b join known k
  on lower(b.name) = lower(k.name) and abs(b.lat - k.lat) < 0.001 and abs(b.lng - k.lng) < 0.001 group by 1""")
def j15(t: Tables):
    return rc.existing_duplicates(insert_batches(t), known_batch(t))


# one step per waiting record in id order; the accepted ones travel along as a list
_GREEDY = """fresh as (select b.*, row_number() over (order by b.id) as n from batch b where not exists (
   select 1 from known k where lower(b.name) = lower(k.name) and abs(b.lat - k.lat) < 0.001 and abs(b.lng - k.lng) < 0.001)),
 walk(n, taken) as (
   select 0::bigint, []::struct(id bigint, name varchar, lat double, lng double)[]
   union all
   select f.n, case when len(list_filter(w.taken, lambda x: lower(x.name) = lower(f.name) and abs(x.lat - f.lat) < 0.001 and abs(x.lng - f.lng) < 0.001)) > 0
     then w.taken else list_append(w.taken, {'id': f.id, 'name': f.name, 'lat': f.lat, 'lng': f.lng}) end
   from walk w join fresh f on f.n = w.n + 1)"""


@query("j15_accept_new", S.with_(S.V, _BATCH, _GREEDY) + "select x.id from (select unnest(taken) as x from walk where n = (select max(n) from fresh))")
def j15b(t: Tables):
    return rc.accept_new(insert_batches(t), known_batch(t)).select("id")


@query("j16_match_price_list")
def j16(t: Tables):
    return fz.match_price_list(t.venues(), t.price_list()).withColumn("match_score", r6("match_score"))


@query("j17_match_register")
def j17(t: Tables):
    return fz.match_register(t.venues(), t.register()).withColumn("confidence", r6("confidence"))


@query("j18_match_coverage")
def j18(t: Tables):
    v, r = t.venues(), t.register()
    return fz.match_coverage(v, r, fz.match_register(v, r)).withColumn("match_rate", r6("match_rate"))


@query("j19_nearest_name")
def j19(t: Tables):
    v, p = t.venues(), t.price_list()
    wanted = t.raw("supplier").select(F.col("s_suppkey").alias("entry"), F.lower("s_name").alias("name"))
    return fz.addable_prices(fz.nearest_name(v, p.select("entry", "name"), 0.6), v, wanted).select("entry", "match_id", r6("match_score").alias("match_score"))


_PRICES = "prices as (select " + ", ".join(f"{sql} as {c}" for c, sql in X.PRICE_LIST.items()) + " from supplier join v on v.id = s_suppkey)"
_BAND = "case when p is null then null when p < 15 then 'Cheap' when p < 30 then 'Mid-range' when p < 60 then 'Upscale' else 'Fine Dining' end"


@query("j20_apply_prices", S.with_(S.V, _PRICES) + f"""select id, p as average_price_eur, {_BAND} as price_category,
   coalesce(price_level, case when p is null then null when p < 15 then '1' when p < 30 then '2' when p < 60 then '3' else '4' end) as price_level, thefork_url
  from (select v.id, v.price_level, l.average_price as p, l.thefork_url from v left join (
    select * from (select lower(v.name) as k, average_price, thefork_url, row_number() over (partition by lower(v.name) order by entry desc) as rn
    from prices join v on v.id = entry) where rn = 1) l on lower(v.name) = l.k)""")
def j20(t: Tables):
    # entries are matched to the venue with their number, so that SQL can repeat it
    matches = t.price_list().select("entry", F.col("entry").alias("match_id"))
    out = fz.apply_prices(t.venues(), t.price_list(), matches)
    return out.select("id", "average_price_eur", "price_category", "price_level", "thefork_url")


def ext_matched(t: Tables):
    e = t.external().withColumnsRenamed({"outdoor": "outdoor_seating", "vegan": "diet_vegan", "vegetarian": "diet_vegetarian", "halal": "diet_halal"})
    return rc.match_by_name_then_place(e, t.venues())


_FILLED = f"""matched as (select ext.*, coalesce(first_pass, second_pass) as match_id from ext join hits using (ext_id) where coalesce(first_pass, second_pass) is not null),
 offers as (select match_id, arg_min(outdoor, ext_id) filter (where outdoor is not null) as outdoor_seating, arg_min(wheelchair, ext_id) filter (where wheelchair is not null) as wheelchair,
   arg_min(vegan, ext_id) filter (where vegan is not null) as diet_vegan, arg_min(vegetarian, ext_id) filter (where vegetarian is not null) as diet_vegetarian,
   arg_min(halal, ext_id) filter (where halal is not null) as diet_halal from matched group by 1),
 filled as (select v.id, case when v.id % 10 = 0 then 'limited' else o.wheelchair end as wheelchair, o.outdoor_seating, o.diet_vegan, o.diet_vegetarian, o.diet_halal
   from v left join offers o on o.match_id = v.id)"""
FILLED = S.with_(S.V, S.EXTERNAL, _PAIRS_A, _FILLED)


def filled(t: Tables):
    v = t.venues().withColumn("wheelchair", F.expr("case when id % 10 = 0 then 'limited' end"))
    return rc.fill_attributes(v, ext_matched(t)).select("id", "wheelchair", "outdoor_seating", "diet_vegan", "diet_vegetarian", "diet_halal")


@query("j21_fill_attributes", FILLED + "select * from filled")
def j21(t: Tables):
    return filled(t)


@query("a11_attribute_coverage", FILLED + """select count(*) filter (where outdoor_seating = 'yes') as outdoor_seating, count(*) filter (where wheelchair <> '') as wheelchair,
  count(*) filter (where diet_vegan in ('yes', 'only')) as vegan, count(*) filter (where diet_vegetarian in ('yes', 'only')) as vegetarian from filled""")
def a11(t: Tables):
    return rp.attribute_coverage(filled(t))


# --- cells -------------------------------------------------------------------------------

@query("j01_cell_features", FEAT + f"""select id, hex_restaurant_count, {S.r6('hex_mean_rating')} as hex_mean_rating, {S.r6('hex_cuisine_entropy')} as hex_cuisine_entropy,
  {S.r6('hex_chain_share')} as hex_chain_share from featured left join cells using (cell) left join entropy using (cell)""")
def j01(t: Tables):
    f = featured(t)
    return f.select("id", "hex_restaurant_count", *[r6(c).alias(c) for c in ("hex_mean_rating", "hex_cuisine_entropy", "hex_chain_share")])


def rows(t: Tables):
    from savorgrid.plans.features import row_features

    return row_features(t.places(), PACK, HEX)


@query("a01_cell_counts", FEAT + f"select cell, hex_restaurant_count, {S.r6('hex_mean_rating')} as hex_mean_rating from cells")
def a01(t: Tables):
    return ce.cell_counts(rows(t)).select("cell", "hex_restaurant_count", r6("hex_mean_rating").alias("hex_mean_rating"))


@query("a02_cell_entropy", FEAT + f"select cell, {S.r6('hex_cuisine_entropy')} as hex_cuisine_entropy from entropy")
def a02(t: Tables):
    return ce.category_entropy(rows(t)).select("cell", r6("hex_cuisine_entropy").alias("hex_cuisine_entropy"))


@query("a03_cell_chain_share", FEAT + f"select cell, {S.r6('hex_chain_share')} as hex_chain_share from cells")
def a03(t: Tables):
    return ce.chain_share(rows(t)).select("cell", r6("hex_chain_share").alias("hex_chain_share"))


_HEX_AGG = """hexes as (select cell, avg(rating) as mean_rating, avg(residual) as mean_residual, sum(review_count)::bigint as total_reviews, avg(review_count) as mean_reviews,
  avg(is_chain::int) as chain_share, avg(price_numeric) as mean_price, count(distinct category) as cuisine_diversity, count(name) as restaurant_count from featured group by 1)"""
HEXES = S.with_(S.V, S.CLEAN, S.FEATURED, _HEX_AGG)
_HEX_COLS = ["mean_rating", "mean_residual", "mean_reviews", "chain_share", "mean_price"]


@query("a04_hex_table", HEXES + "select cell, total_reviews, cuisine_diversity, restaurant_count, " + ", ".join(f"{S.r6(c)} as {c}" for c in _HEX_COLS) + " from hexes")
def a04(t: Tables):
    return ce.hex_table(rows(t)).select("cell", "total_reviews", "cuisine_diversity", "restaurant_count", *[r6(c).alias(c) for c in _HEX_COLS])


_CLUSTERED = "clustered as (select *, (cell % 4)::int as cluster from hexes), stats as (select cluster, avg(mean_rating) as mean_rating, avg(mean_residual) as mean_residual, avg(restaurant_count) as restaurant_count from clustered group by 1)"
CLUSTERED = S.with_(S.V, S.CLEAN, S.FEATURED, _HEX_AGG, _CLUSTERED)


def given_clusters(t: Tables):
    """Hex table with clusters given by the cell number, so that SQL can follow."""
    return ce.hex_table(rows(t)).withColumn("cluster", (F.col("cell") % 4).cast("int"))


@query("a05_cluster_stats", CLUSTERED + f"select cluster, {S.r6('mean_rating')} as mean_rating, {S.r6('mean_residual')} as mean_residual, {S.r6('restaurant_count')} as restaurant_count from stats")
def a05(t: Tables):
    return ce.cluster_stats(given_clusters(t)).select("cluster", *[r6(c).alias(c) for c in ("mean_rating", "mean_residual", "restaurant_count")])


_LABELLED = f"""labels_c as (select cluster, (['Elite', 'Strong', 'Everyday', 'Emerging'])[row_number() over (order by mean_rating desc, cluster)] as cluster_label from stats)"""
LABELLED = S.with_(S.V, S.CLEAN, S.FEATURED, _HEX_AGG, _CLUSTERED, _LABELLED)


@query("w08_cluster_labels", LABELLED + "select cell, cluster, cluster_label from clustered join labels_c using (cluster)")
def w08(t: Tables):
    return ce.label_clusters(given_clusters(t)).select("cell", "cluster", "cluster_label")


# --- reports ---------------------------------------------------------------------------------

@query("a06_district_reviews", SCORED + "select district, sum(review_count)::bigint as total_reviews from scored group by 1")
def a06(t: Tables):
    return rp.district_reviews(zoned(t))


@query("a07_category_counts", SCORED + "select district, category, count(*) as n from scored group by 1, 2")
def a07(t: Tables):
    return rp.category_counts(zoned(t))


@query("a07_category_pivot", SCORED + """select district, nullif(count(*) filter (where category = 'Cafe'), 0) as "Cafe", nullif(count(*) filter (where category = 'Turkish'), 0) as "Turkish" from scored group by 1""")
def a07b(t: Tables):
    return rp.category_pivot(zoned(t), ["Cafe", "Turkish"])


_STATS = SCORED + """select district, round_even(avg(rating), 2) as avg_rating, sum(review_count)::bigint as total_reviews, round_even(avg(score), 2) as avg_score,
  count(name) as restaurant_count from scored group by 1"""


@query("a08_district_stats", _STATS)
def a08(t: Tables):
    return rp.district_stats(scored(t))


query("q04_district_stats", _STATS)(lambda t: rp.district_stats(scored(t)))


_FULL = """expected as (select f.*, case when c3.n >= 3 then c3.m when c2.n >= 3 then c2.m else c1.m end as predicted_rating from featured f
  join (select category, price_numeric, cell, avg(rating) as m, count(*) as n from featured group by 1, 2, 3) c3 using (category, price_numeric, cell)
  join (select category, price_numeric, avg(rating) as m, count(*) as n from featured group by 1, 2) c2 using (category, price_numeric)
  join (select category, avg(rating) as m, count(*) as n from featured group by 1) c1 using (category))"""
EXPECTED = S.with_(S.V, S.CLEAN, S.FEATURED, _FULL)


def expected(t: Tables):
    return md.expected_rating(rows(t))


def _hist(sub: str) -> str:
    return f"(select string_agg(k || '=' || n::varchar, ',' order by k) from ({sub}))"


_SUMMARY = S.with_(S.V, S.CLEAN, S.FEATURED, _HEX_AGG, _CLUSTERED, _LABELLED, _FULL) + f"""select count(*) as total_restaurants, {S.r6('avg(rating)')} as mean_rating, {S.r6('avg(predicted_rating)')} as mean_predicted,
  {S.r6('avg(rating - predicted_rating)')} as mean_residual, {S.r6('stddev_samp(rating - predicted_rating)')} as std_residual, (select count(*) from hexes) as num_hexagons,
  {_hist('select category as k, count(*) as n from featured group by 1')} as cuisines,
  {_hist('select cluster_label as k, count(*) as n from clustered join labels_c using (cluster) group by 1')} as cluster_counts from expected"""


def summary(t: Tables):
    s = rp.run_summary(expected(t), ce.label_clusters(given_clusters(t)))

    def text(c):
        return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(c)

    return s.select("total_restaurants", *[r6(c).alias(c) for c in ("mean_rating", "mean_predicted", "mean_residual", "std_residual")], "num_hexagons", text("cuisines"), text("cluster_counts"))


query("a09_run_summary", _SUMMARY)(summary)
query("q06_summary", _SUMMARY)(summary)


@query("a10_price_stats", S.with_(S.V, _PRICES) + f"""select count(*) as entries, min(average_price) as min_price, max(average_price) as max_price, {S.r6('avg(average_price)')} as mean_price,
  count(*) filter (where average_price < 15) as cheap, count(*) filter (where average_price >= 15 and average_price < 30) as mid_range,
  count(*) filter (where average_price >= 30 and average_price < 60) as upscale, count(*) filter (where average_price >= 60) as fine_dining from prices""")
def a10(t: Tables):
    return rp.price_stats(t.price_list()).withColumn("mean_price", r6("mean_price"))


def _street_sql() -> str:
    from .q_ingest import STREET_LABEL

    return V + f"select {STREET_LABEL} as street, count(*) as n from v where id % 5 = 0 or review_count = 0 group by 1"


@query("a12_streets_to_enrich", _street_sql())
def a12(t: Tables):
    return rp.streets_to_enrich(t.venues().withColumn("rating", F.expr("case when id % 5 = 0 then null else rating end")))


def _lang_sql() -> str:
    from .q_rules import _LANG

    return f"with lang_counts as (select n_chars % 97 as venue_id, case when doc_id % 4 <> 0 then lang else {_LANG} end as lang, count(*) as n from documents group by 1, 2) "


@query("a13_language_counts", _lang_sql() + "select venue_id, string_agg(lang || '=' || n::varchar, ',' order by lang) as languages from lang_counts group by 1")
def a13(t: Tables):
    m = rv.language_maps(rv.language_counts(t.doc_reviews()))
    pairs = F.transform(F.array_sort(F.map_entries("review_languages")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return m.select("venue_id", F.array_join(pairs, ",").alias("languages"))


@query("a13_overall_languages", _lang_sql() + "select lang, sum(n)::bigint as n from lang_counts group by 1")
def a13b(t: Tables):
    return rv.overall_languages(rv.language_counts(t.doc_reviews()))


_LINE = "lines as (select " + ", ".join(f"{sql} as {c}" for c, sql in X.REVIEW_LINE.items()) + " from lineitem)"


@query("a14_reviewer_quality", S.with_(_LINE) + """select venue_id, local_guides_pct, avg_reviews, case when local_guides_pct >= 60 and avg_reviews >= 30 then 'High'
  when local_guides_pct >= 40 or avg_reviews >= 20 then 'Medium' when local_guides_pct < 20 and avg_reviews < 10 then 'Low' else 'Mixed' end as quality from (
  select venue_id, round_even(count(*) filter (where is_local_guide) / count(*)::double * 100, 0)::int as local_guides_pct,
    coalesce(round_even(avg(nullif(reviewer_review_count, 0)), 0), 0)::int as avg_reviews from lines group by 1)""")
def a14(t: Tables):
    return rv.reviewer_quality(t.line_reviews())


@query("a15_venue_age", S.with_(S.V, _LINE) + """select v.id, case when r.venue_id is null then 'unknown' when y is null or y < 2 then '<2y' when y < 5 then '2-5y' when y < 10 then '5-10y' else '10y+' end as years_open
  from v left join (select venue_id, max(try_cast(nullif(regexp_extract(date, '(\\d+)\\s*year', 1), '') as int)) as y from lines group by 1) r on r.venue_id = v.id""")
def a15(t: Tables):
    return rv.with_age(t.venues().select("id"), rv.venue_age(t.line_reviews()))


@query("a16_vocabularies", SCORED + """select distinct field, value from (select 'category' as field, category as value from scored union all
  select 'district', district from scored union all select 'tier', tier from scored)""")
def a16(t: Tables):
    return api.vocabularies(scored(t))


query("q07_filter_vocabularies", SCORED + """select distinct field, value from (select 'category' as field, category as value from scored union all
  select 'district', district from scored union all select 'tier', tier from scored)""")(lambda t: api.vocabularies(scored(t)))


def labelled(t: Tables):
    docs, labels = t.raw("documents"), t.raw("labels")
    return docs.join(labels, "doc_id").select(
        F.when(F.col("lang") == "en", "control").otherwise("bonus").alias("grp"),
        F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, "DOUBT").otherwise("CORRECT")).otherwise("WRONG").alias("verdict"),
        F.when(F.col("n_chars") < 400, "<2y").when(F.col("n_chars") < 1000, "2-5y").otherwise("5-10y").alias("band"),
        F.col("source").alias("category"), (F.col("n_chars") % 10).cast("double").alias("score"))


_LAB = """lab as (select case when lang = 'en' then 'control' else 'bonus' end as grp, case when quality = 1 then case when toxic = 1 then 'DOUBT' else 'CORRECT' end else 'WRONG' end as verdict,
  case when n_chars < 400 then '<2y' when n_chars < 1000 then '2-5y' else '5-10y' end as band, source as category, (n_chars % 10)::double as score from documents join labels using (doc_id)),
 dims as (select 'group' as dimension, grp as value, verdict, score from lab union all select 'band', band, verdict, score from lab union all select 'category', category, verdict, score from lab)"""


@query("a17_validation_report", S.with_(_LAB) + """select d.dimension, d.value, d.verdict, count(*) as n, round_even(count(*) / any_value(total)::double * 100, 1) as share, any_value(mean_score) as mean_score
  from dims d join (select dimension, value, count(*) as total, round_even(avg(score), 1) as mean_score from dims group by 1, 2) using (dimension, value) group by 1, 2, 3
  union all select dimension, value, null, count(*), 100.0::double, round_even(avg(score), 1) from dims group by 1, 2""")
def a17(t: Tables):
    return rp.validation_report(labelled(t))


@query("a17_false_negatives", S.with_(_LAB) + "select count(*) as control_rows, round_even(count(*) filter (where verdict = 'WRONG') / count(*)::double * 100, 1) as false_negative_pct from lab where grp = 'control'")
def a17b(t: Tables):
    return rp.false_negative_rate(labelled(t), "control", "WRONG")


_SEVERE, _CLOSED_WORDS = ["eratsh", "ndess"], ["closed", "eronth"]
_SENT = {"tion": 0.3, "ment": -0.4, "sch": -0.8, "the": 0.1}
_HITS = {w: f"contains(lower(text), {S.q(w)})" for w in [*_SEVERE, *_CLOSED_WORDS, *_SENT]}
_NH = " + ".join(f"{_HITS[w]}::int" for w in _SENT)
_SUMS = " + ".join(f"case when {_HITS[w]} then {S.q(s)} else 0 end" for w, s in _SENT.items())


@query("a18_review_flags", f"""with r as (select doc_id as review_id, n_chars % 97 as venue_id, 1 + doc_id % 5 as rating, text,
    case when {_NH} > 0 then ({_SUMS}) / ({_NH}) else 0.0::double end as sentiment,
    {_HITS['eratsh']} as s0, {_HITS['ndess']} as s1, ({' or '.join(_HITS[w] for w in _CLOSED_WORDS)}) as cl from documents),
  g as (select venue_id, count(*) as review_count, round_even(avg(rating), 2) as avg_rating, round(avg(sentiment), 6) + 0.0 as avg_sentiment,
    concat_ws(',', case when bool_or(s0) then 'eratsh' end, case when bool_or(s1) then 'ndess' end) as severe_words, bool_or(cl) as maybe_closed,
    count(*) filter (where rating <= 2) as low_ratings from r group by 1),
  s as (select venue_id, string_agg(review_id::varchar, ',' order by review_id) as samples from (
    select *, row_number() over (partition by venue_id order by review_id) as rn from r where sentiment < 0) where rn <= 3 group by 1)
  select * from (select venue_id, review_count, avg_rating, avg_sentiment, severe_words, maybe_closed, low_ratings,
    concat_ws('|', case when severe_words <> '' then 'severe words' end, case when maybe_closed then 'possibly closed' end,
      case when low_ratings / review_count::double >= 0.3 then 'many low ratings' end, case when avg_sentiment < 0 then 'negative sentiment' end) as issues,
    samples from g left join s using (venue_id)) where issues <> ''""")
def a18(t: Tables):
    f = rv.review_flags(t.doc_reviews(), _SEVERE, _CLOSED_WORDS, _SENT)
    ids = F.array_join(F.transform("sample_negative", lambda s: s["review_id"].cast("string")), ",")
    return f.select("venue_id", "review_count", "avg_rating", r6("avg_sentiment").alias("avg_sentiment"), F.array_join("severe_words", ",").alias("severe_words"),
                    "maybe_closed", "low_ratings", F.array_join("issues", "|").alias("issues"), ids.alias("samples"))


@query("a19_top_rated", V + f"select id, name, rating, review_count, (select {S.r6('avg(rating)')} from v where rating > 0) as average_rating from v where rating > 0 order by rating desc, review_count desc, id limit 10")
def a19(t: Tables):
    return rp.top_rated(t.venues()).select("id", "name", "rating", "review_count", r6("average_rating").alias("average_rating"))


# --- rankings ----------------------------------------------------------------------------------

@query("w01_ranks", SCORED + """select id, rating_rank, score_rank, rating_rank - score_rank as rank_improvement from (
  select id, rank() over (order by rating desc) as rating_rank, rank() over (order by round(score, 9) desc) as score_rank from scored)""")
def w01(t: Tables):
    ranked = rk.with_ranks(scored(t).select("id", "rating", F.round("score", 9).alias("score")))
    return ranked.select("id", "rating_rank", "score_rank", "rank_improvement")


@query("w02_top_per_district", SCORED + "select district, id from (select *, row_number() over (partition by district order by round(score, 9) desc, id) as rn from scored) where rn = 1")
def w02(t: Tables):
    return rk.top_per_group(scored(t).withColumn("score", F.round("score", 9)), "district", "score").select("district", "id")


@query("w03_top_n", SCORED + f"select id, {S.r6('round(score, 9)')} as score from scored order by round(score, 9) desc, id limit 100000")
def w03(t: Tables):
    return rk.top_n(scored(t).withColumn("score", F.round("score", 9)), "score", 100000).select("id", r6("score").alias("score"))


@query("w04_top_then_filter", SCORED + "select id from (select * from scored order by round(score, 9) desc, id limit 100) where price_numeric = 2 and contains(lower(name), 'e')")
def w04(t: Tables):
    f = VenueFilter(top_scored=True, search="e", price=2)
    return api.list_venues(scored(t).withColumn("score", F.round("score", 9)), PACK, f).select("id")


@query("w05_sorted_venues", V + "select id, row_number() over (order by rating desc, id) as pos from v")
def w05(t: Tables):
    return rk.with_positions(t.venues().select("id", "rating"), "rating").select("id", "pos")


@query("w06_category_top", SCORED + f"select id, category from scored where category in {S.in_list(PACK.community_categories)} order by round(score, 9) desc, id limit 50")
def w06(t: Tables):
    return rk.subset_top(scored(t).withColumn("score", F.round("score", 9)), "category", PACK.community_categories).select("id", "category")


@query("w07_priority_order", EXT + f"select ext_id, priority from (select ext_id, {_CLASS} as priority from (select *, {S.osm_category('cuisine_tag')} as cuisine from ext))")
def w07(t: Tables):
    e = ext_with_cuisine(t).withColumn("priority", rc.priority_class(PACK, F.col("cuisine")))
    return e.orderBy("priority", "ext_id").select("ext_id", "priority")


_GEMS = V + "select id, round_even(residual * 100, 1) as undervaluation_pct from v order by residual desc, id limit 100"


@query("w09_undervaluation", _GEMS)
def w09(t: Tables):
    return rk.gems(t.venues(), 100).select("id", "undervaluation_pct")


# --- models ---------------------------------------------------------------------------------------

_DESIGN = FEAT + f"""select id, {S.r6('log_review_count')} as log_review_count, price_numeric::double as price_numeric, is_chain::int::double as is_chain, hex_restaurant_count::double as hex_restaurant_count,
  {S.r6('hex_mean_rating')} as hex_mean_rating, {S.r6('hex_cuisine_entropy')} as hex_cuisine_entropy, {S.r6('hex_chain_share')} as hex_chain_share,
  (category = 'Cafe')::int as "category_Cafe", (category = 'Turkish')::int as "category_Turkish", (venue_type = 'Bar')::int as "venue_Bar", rating
  from featured left join cells using (cell) left join entropy using (cell)"""


@query("m01_design_table", _DESIGN)
def m01(t: Tables):
    d = md.design_table(featured(t), ["Cafe", "Turkish"], ["Bar"])
    return d.select(*[r6(c).alias(c) if c in ("log_review_count", "hex_mean_rating", "hex_cuisine_entropy", "hex_chain_share") else c for c in d.columns])


def modelled(t: Tables):
    f = featured(t)
    return md.predict(md.train(f), f)


@query("m02_expected_by_trees")
def m02(t: Tables):
    return modelled(t).select("id", "rating", r6("predicted_rating").alias("predicted_rating"), r6("residual").alias("residual"))


@query("m03_cross_validation")
def m03(t: Tables):
    return md.cross_validate(featured(t))


@query("m04_residuals", EXPECTED + f"select id, {S.r6('rating - predicted_rating')} as residual from expected")
def m04(t: Tables):
    return md.add_residual(expected(t).drop("residual")).select("id", r6("residual").alias("residual"))


@query("m05_neighbourhood_clusters")
def m05(t: Tables):
    h = md.neighbourhoods(rows(t), HEX)
    return h.select("cell", "cluster", "cluster_label", r6("hub_score").alias("hub_score"), r6("hex_lat").alias("hex_lat"))


@query("m06_save_and_load")
def m06(t: Tables):
    f, path = featured(t), scratch(t.spark)
    md.save_model(md.train(f), path)
    return md.predict(md.load_model(path), f).select("id", r6("predicted_rating").alias("predicted_rating"))


@query("m07_expected_by_groups", EXPECTED + f"select id, {S.r6('predicted_rating')} as predicted_rating from expected")
def m07(t: Tables):
    return expected(t).select("id", r6("predicted_rating").alias("predicted_rating"))


# --- composed queries ---------------------------------------------------------------------------------

_BADGED = f"({S.STARS} > 0 or {S.BIB} or {S.GUIDE})"


@query("q01_venue_list", SCORED + f"""select id, name, {S.r6('score')} as score, tier, district, {S.r6('c_base_quality')} as score_base_quality from scored
  where rating >= 3.2 and review_count >= 5 and {_BADGED} and (opening_hours is null or not contains(list_filter(opening_hours, lambda h: starts_with(h, 'Friday'))[1], 'Closed'))""")
def q01(t: Tables):
    f = VenueFilter(min_rating=3.2, min_reviews=5, category="all", guide="any_guide", open_day="Friday", sort_by="score")
    out = api.list_venues(scored(t), PACK, f)
    return out.select("id", "name", r6("score").alias("score"), "tier", "district", r6("score_base_quality").alias("score_base_quality"))


@query("q02_residual_gems", EXPECTED + """select id, category, undervaluation_pct from (select *, round(rating - predicted_rating, 9) as res, round_even(round(rating - predicted_rating, 9) * 100, 1) as undervaluation_pct from expected)
  order by res desc, id limit 50""")
def q02(t: Tables):
    e = expected(t).withColumn("residual", F.round("residual", 9))
    return api.residual_gems(e).select("id", "category", "undervaluation_pct")


@query("q03_score_gems", SCORED + f"select id, name, district, tier, {S.r6('score')} as score from scored order by round(score, 9) desc, id limit 50")
def q03(t: Tables):
    s = scored(t).withColumn("score", F.round("score", 9))
    return api.score_gems(s).select("id", "name", "district", "tier", r6("score").alias("score"))


@query("q05_community_top", SCORED + f"select id, category, district, {S.r6('score')} as score from scored where category in {S.in_list(PACK.community_categories)} order by round(score, 9) desc, id limit 50")
def q05(t: Tables):
    s = scored(t).withColumn("score", F.round("score", 9))
    return api.community_venues(s, PACK).select("id", "category", "district", r6("score").alias("score"))


_KEPT = f"""kept as (select *, round(score, 9) as sc9 from scored where not {S.SHOP} and not coalesce(primary_type in {S.in_list(PACK.removed_types)}, false) and lower(name) not in {CLOSED}),
 ranked as (select *, rank() over (order by rating desc) - rank() over (order by sc9 desc) as moved from kept)"""


@query("q08_ranking_report", S.with_(*S.SCORED, _KEPT) + f"""select 'top' as section, id, {S.r6('sc9')} as value from (select * from kept order by sc9 desc, id limit 20)
  union all select 'district', id, {S.r6('sc9')} from (select *, row_number() over (partition by district order by sc9 desc, id) as rn from kept) where rn = 1
  union all select 'winners', id, moved::double from (select * from ranked order by moved desc, id limit 10)
  union all select 'community', id, {S.r6('sc9')} from (select * from kept where category in {S.in_list(PACK.community_categories)} order by sc9 desc, id limit 10)
  union all select 'spotlight', id, {S.r6('sc9')} from (select * from kept where district in {S.in_list(PACK.spotlight_districts)} order by sc9 desc, id limit 10)""")
def q08(t: Tables):
    v = t.venues().withColumn("price_numeric", price_number(F.col("price_level")))
    s = sc.rerank(v, PACK, closed_names(t)).withColumn("score", F.round("score", 9))
    return api.ranking_report(s, PACK).select("section", "id", r6("value").alias("value"))


_CORNER_X = f"({HEX_X}) + {S.q(HEX.edge_km * 0.8660254037844387)}"
_CORNER_Y = f"({HEX_Y}) - {S.q(HEX.edge_km * 0.5)}"


@query("q09_hex_geojson", LABELLED.rstrip() + f""" select cell, 'Feature' as kind, 7 as ring_points, round_even(mean_rating, 2) as mean_rating, restaurant_count::int as restaurant_count, cluster_label,
  {S.r6(_latlng(_CORNER_X, _CORNER_Y)[1])} as first_lng, {S.r6(_latlng(_CORNER_X, _CORNER_Y)[0])} as first_lat
  from (select *, {AXIAL} from clustered join labels_c using (cluster))""")
def q09(t: Tables):
    h = ce.label_clusters(given_clusters(t)).withColumn("hub_score", F.col("mean_rating"))
    doc = F.from_json("feature", "type string, properties struct<mean_rating:double,restaurant_count:int,cluster_label:string>, geometry struct<type:string,coordinates:array<array<array<double>>>>")
    out = md.hex_features_json(h, HEX).withColumn("f", doc)
    ring = F.col("f.geometry.coordinates")[0]
    return out.select("cell", F.col("f.type").alias("kind"), F.size(ring).alias("ring_points"), "f.properties.mean_rating", "f.properties.restaurant_count",
                      "f.properties.cluster_label", r6(ring[6][0]).alias("first_lng"), r6(ring[0][1]).alias("first_lat"))


# --- traffic and streams ------------------------------------------------------------------------------

def views(t: Tables):
    return t.raw("events").filter("event_type = 'view'")


_DAILY = "daily as (select cast(ts as date) as day, count(*) as views from events where event_type = 'view' group by 1)"


@query("t01_daily_views_stream", S.with_(_DAILY) + "select day, views from daily order by day desc limit 90")
def t01(t: Tables):
    """The counter as a stream over the event files; the newest ninety days are kept."""
    stream = t.stream("events")
    sink, ckpt = scratch(t.spark), scratch(t.spark)
    q = tr.start_daily_views(stream.filter("event_type = 'view'").withColumn("ts", F.col("ts").cast("timestamp")), sink, ckpt)
    q.awaitTermination()
    return tr.keep_newest(tr.read_daily(t.spark, sink))


_SERIES = _DAILY + """, spine as (select cast(unnest(range((select max(day) - 58 from daily)::timestamp, (select max(day) + 1 from daily)::timestamp, interval 1 day)) as date) as day),
 dense as (select day, coalesce(views, 0) as views from spine left join daily using (day)),
 series as (select day, views, sum(views) over (order by day rows between 6 preceding and current row)::bigint as last_7,
   sum(views) over (order by day rows between 29 preceding and current row)::bigint as last_30 from dense)"""


@query("t02_rolling_views", S.with_(_SERIES) + "select * from series where day > (select max(day) - 30 from daily)")
def t02(t: Tables):
    return tr.view_series(tr.daily_views(views(t)))


@query("q10_traffic_stats", S.with_(_DAILY) + """select sum(views)::bigint as total, sum(views) filter (where day = (select max(day) from daily))::bigint as today,
  sum(views) filter (where day > (select max(day) - 7 from daily))::bigint as last_7_days, sum(views) filter (where day > (select max(day) - 30 from daily))::bigint as last_30_days from daily""")
def q10(t: Tables):
    return tr.traffic_stats(tr.daily_views(views(t)))


@query("t03_review_stream", """select distinct n_chars % 97 as venue_id, coalesce(source, '') || '::' || sha256(coalesce(text, '')) as review_key from documents""")
def t03(t: Tables):
    """Reviews as a stream with one event time; repeats are dropped on the way."""
    docs = t.stream("documents")
    stream = docs.select(F.expr("n_chars % 97").alias("venue_id"), F.col("source").alias("reviewer_name"), "text", "doc_id",
                         F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, doc_id % 3600)").alias("ts"))
    sink = scratch(t.spark)
    st_rev.start_review_ingest(stream, sink, scratch(t.spark)).awaitTermination()
    return st_rev.current_reviews(t.spark, sink).select("venue_id", "review_key")


@query("x21_smooth_totals", V + f"select brand, {S.r6('avg(ln(1 + review_count))')} as mean_log_reviews from v group by 1")
def x21b(t: Tables):
    return t.venues().groupBy("brand").agg(r6(F.avg(nu.log_reviews(F.col("review_count")))).alias("mean_log_reviews"))
