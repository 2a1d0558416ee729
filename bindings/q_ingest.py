"""Sources, sinks, projections, merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from savorgrid.functions import address as ad
from savorgrid.functions import money as mo
from savorgrid.operators import ingest as ing
from savorgrid.operators import merges as mg
from savorgrid.sources import readers as rd
from savorgrid.sources import writers as wr

from . import expressions as X
from . import sql as S
from .registry import query, r6, scratch
from .tables import PACK, Tables

V = S.with_(S.V)
EXT = S.with_(S.V, S.EXTERNAL)


@query("s01_read_places", V + f"""select id::varchar as id, name, coalesce(address, '') as address, {S.r6('lat')} as lat,
  rating, review_count, len(types) as n_types from v""")
def s01(t: Tables):
    path = scratch(t.spark)
    rows = t.places().withColumns({"id": F.col("id").cast("string"), "address": F.coalesce("address", F.lit(""))})
    wr.write_json(rows.select("id", "name", "address", "lat", "lng", "rating", "review_count", "types"), path)
    back = rd.read_places(t.spark, path)
    return back.select("id", "name", "address", r6("lat").alias("lat"), "rating", "review_count",
                       F.size("types").cast("bigint").alias("n_types"))


@query("s02_first_available_table", V + "select id, name, rating, len(opening_hours) as days from v")
def s02(t: Tables):
    path = scratch(t.spark)
    wr.write_table(t.venues().select("id", "name", "rating", "opening_hours"), path)
    back = rd.read_first_available(t.spark, [path + "-missing", path])
    return back.select("id", "name", "rating", F.size("opening_hours").cast("bigint").alias("days"))


_REG_SRC = "supplier join (select *, cast(id as bigint) as vid from v) on s_suppkey = vid"
_REG = "reg as (select " + ", ".join(f"{sql} as {c}" for c, sql in X.REGISTER.items()) + f" from {_REG_SRC})"
REGISTER_SQL = S.with_(S.V, _REG)


@query("s03_register_csv", REGISTER_SQL + f"""select reg_id as id, name, street, postcode, municipality from reg
  where ord % 11 <> 5 and postcode in {S.in_list(PACK.register_postcodes)}""")
def s03(t: Tables):
    path = scratch(t.spark)
    reg = t.register()
    fields = ["reg_id", "name", "street", "house_nr", "postcode", "municipality", "code", "valid_until"]
    quoted = [F.concat(F.lit('"'), F.col(c), F.lit('"')) for c in fields]
    # some lines are cut short after five fields and must be skipped
    line = F.when(F.expr("ord % 11 = 5"), F.concat_ws(";", *quoted[:5])).otherwise(F.concat_ws(";", *quoted))
    reg.select(line.alias("value")).write.text(path)
    raw = t.spark.read.text(path)
    return rd.parse_register(raw, PACK.register_postcodes).select("id", "name", "street", "postcode", "municipality")


@query("s04_candidates_csv", V + """select id::varchar as id, name, rating, review_count, round(lat, 6) as lat from v
  where id % 5 <> 0 and id % 7 <> 0 and rating between 1 and 5 and review_count >= 5""")
def s04(t: Tables):
    path = scratch(t.spark)
    v = t.venues()
    rows = v.select(
        F.col("id").cast("string").alias("id"), "name", "address", "lat", "lng", F.lit("Other").alias("cuisine"),
        F.expr("case when id % 5 = 0 then '' else cast(rating as string) end").alias("rating"),
        F.expr("case when id % 7 = 0 then 'many' else cast(review_count as string) end").alias("review_count"),
    )
    rows.write.csv(path, header=True)
    return rd.read_candidates(t.spark, path).select("id", "name", "rating", "review_count", F.round("lat", 6).alias("lat"))


@query("s05_write_csv", V + "select id::varchar as id, name, (opening_hours is not null) as has_hours from v")
def s05(t: Tables):
    path = scratch(t.spark)
    wr.write_csv(t.venues().select("id", "name", "opening_hours"), path)
    back = t.spark.read.csv(path, header=True, escape='"', schema="id string, name string, opening_hours string")
    return back.select("id", "name", F.col("opening_hours").isNotNull().alias("has_hours"))


@query("s06_write_json_and_worklist", EXT + """select name, 1 as priority,
  'https://www.google.com/maps/search/' || replace(name || ' ' || coalesce(street, ''), ' ', '+') as google_maps_link from ext""")
def s06(t: Tables):
    path = scratch(t.spark)
    e = t.external().select("name", F.coalesce("street", F.lit("")).alias("address"), "lat", "lng",
                            F.lit("Other").alias("cuisine"), F.lit(1).alias("priority"))
    wr.write_json(wr.candidate_worklist(e), path)
    return t.spark.read.schema("name string, priority int, google_maps_link string").json(path)


@query("s07_mention_lookup", S.with_(S.V) + "select trim(lower(name)) as key, arg_max(id % 12, id) as mentions from v group by 1")
def s07(t: Tables):
    rows = t.venues().select("name", F.expr("id % 12").alias("reddit_mentions"), "id")
    return rd.mention_lookup(rows, "id")


@query("s08_city_pack", S.with_(*S.SCORED[:2]) + f"""select z.district, d.district_tier as tier, {S.r6('d.weight')} as weight, count(*) as n
  from zoned z join districts d on d.district = z.district group by 1, 2, 3""")
def s08(t: Tables):
    from savorgrid.operators.zones import with_zones

    dims = PACK.district_frame(t.spark).select("district", "tier", "weight")
    return (
        with_zones(t.venues(), PACK).groupBy("district").agg(F.count(F.lit(1)).alias("n")).join(dims, "district")
        .select("district", "tier", r6("weight").alias("weight"), "n")
    )


# --- projections ----------------------------------------------------------------------

@query("p01_flatten_places", S.with_(S.V, S.PERIODS) + f"""select id::varchar as id, name, coalesce(address, '') as address, {S.r6('lat')} as lat, {S.r6('lng')} as lng,
  rating, review_count, price_level, case when id % 7 = 3 then '' else types_csv end as types, coalesce(primary_type, '') as primary_type,
  case when id % 2 = 0 then coalesce(primary_type, '') else '' end as primary_type_display,
  'https://maps.example/' || id::varchar as google_maps_url, coalesce(len(opening_hours), 0)::int as n_hours from v""")
def p01(t: Tables):
    p = ing.flatten_places(t.payloads())
    return p.select("id", "name", "address", r6("lat").alias("lat"), r6("lng").alias("lng"), "rating", "review_count", "price_level",
                    F.array_join("types", ",").alias("types"), "primary_type", "primary_type_display", "google_maps_url",
                    F.size("opening_hours").alias("n_hours"))


@query("p02_structured_hours", S.with_(S.V, S.PERIODS) + """select v.id::varchar as id, coalesce(array_to_string(days, ','), '') as days_open,
  coalesce(closing, '') as closing_times from v left join open_days using (id) left join close_map using (id)""")
def p02(t: Tables):
    h = ing.structured_hours(t.payloads())
    pairs = F.transform(F.array_sort(F.map_entries("closing_times")), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"]))
    return h.select("id", F.array_join(F.col("days_open").cast("array<string>"), ",").alias("days_open"),
                    F.array_join(pairs, ",").alias("closing_times"))


_OSM_ADDRESS = """concat_ws(', ', case when street is not null then trim(concat_ws(' ', street, house)) end, postcode)"""


@query("p03_flatten_osm", EXT + f"""select ext_id as osm_id, case when is_way then 'way' else 'node' end as osm_type, name,
  case when {_OSM_ADDRESS} = '' then 'Demo, Nowhere' else {_OSM_ADDRESS} end as address, {S.r6('lat')} as lat, {S.r6('lng')} as lng,
  amenity, coalesce(wheelchair, '') as wheelchair from ext where not (is_way and id % 8 = 0)""")
def p03(t: Tables):
    o = ing.flatten_osm(t.osm_elements(), "Demo, Nowhere")
    return o.select("osm_id", "osm_type", "name", "address", r6("lat").alias("lat"), r6("lng").alias("lng"), "amenity", "wheelchair")


@query("p04_osm_category", EXT + f"select {S.osm_category('cuisine_tag')} as cuisine, count(*) as n from ext where not (is_way and id % 8 = 0) group by 1")
def p04(t: Tables):
    return ing.flatten_osm(t.osm_elements()).groupBy("cuisine").agg(F.count(F.lit(1)).alias("n"))


@query("p05_search_links", V + "select id, 'https://maps.example/search/' || replace(name || ' ' || coalesce(address, ''), ' ', '+') as link from v")
def p05(t: Tables):
    return t.venues().select("id", ad.search_link("https://maps.example/search/", F.col("name"), F.col("address")).alias("link"))


@query("p06_price_number", V + f"select {S.PRICE_NUM} as price_numeric, count(*) as n from v group by 1")
def p06(t: Tables):
    return t.venues().groupBy(mo.price_number(F.col("price_level")).alias("price_numeric")).agg(F.count(F.lit(1)).alias("n"))


@query("p07_price_band", V + """select id, case when price_eur < 15 then 1 when price_eur < 30 then 2 when price_eur < 60 then 3 else 4 end as level,
  case when price_eur < 15 then '$' when price_eur < 30 then '$$' when price_eur < 60 then '$$$' else '$$$$' end as symbol,
  case when price_eur < 15 then 'Cheap' when price_eur < 30 then 'Mid-range' when price_eur < 60 then 'Upscale' else 'Fine Dining' end as label from v""")
def p07(t: Tables):
    b = mo.price_band(F.col("price_eur"))
    return t.venues().select("id", b["level"].alias("level"), b["symbol"].alias("symbol"), b["label"].alias("label"))


@query("p08_cover_grid", V + f"""select brand as area, i, j, {S.r6('south + i * (step / 111.0::double)')} as lat, {S.r6('west + j * (step / 71.0::double)')} as lng
  from (select *, unnest(range(0, floor((east - west) / (step / 71.0::double))::int + 1))::int as j from (
    select *, unnest(range(0, floor((north - south) / (step / 111.0::double))::int + 1))::int as i from (
      select brand, min(lat) as south, max(lat) as north, min(lng) as west, max(lng) as east, 0.7::double as step from v group by 1)))""")
def p08(t: Tables):
    areas = t.venues().groupBy(F.col("brand").alias("area")).agg(
        F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east")
    ).withColumns({"step_km": F.lit(0.7), "radius": F.lit(800)})
    return ing.cover_grid(areas).select("area", "i", "j", r6("lat").alias("lat"), r6("lng").alias("lng"))


@query("p09_present_columns", V + "select id, name, case when id % 3 = 0 then null else rating end as rating, review_count from v")
def p09(t: Tables):
    df = t.venues().withColumn("rating", F.when(F.expr("id % 3 = 0"), F.lit(float("nan"))).otherwise(F.col("rating")))
    return ing.present_columns(df, ["id", "name", "score_unknown", "rating", "review_count"])


_HEAD = "split_part(address, ',', 1)"
STREET_LABEL = f"""case when coalesce(address, '') = '' then 'Unknown' else
  array_to_string(list_filter(string_split(trim({_HEAD}), ' '), lambda w: not regexp_matches(w, '^[0-9]*$')), ' ') end"""


@query("p10_street_label", V + f"select id, {STREET_LABEL} as street from v")
def p10(t: Tables):
    return t.venues().select("id", ad.street_label(F.col("address")).alias("street"))


POSTCODE = "nullif(regexp_extract(coalesce(address, ''), '\\b(1\\d{3})\\b', 1), '')"
STREET_NAME = "trim(regexp_replace(regexp_replace(regexp_replace(coalesce(address, ''), '\\b1\\d{3}\\b.*$', ''), '\\s+\\d+[A-Za-z]?\\s*,?\\s*$', ''), ',\\s*$', ''))"


@query("p11_postcode_and_street", V + f"select id, {POSTCODE} as postcode, {STREET_NAME} as street from v")
def p11(t: Tables):
    a = F.col("address")
    return t.venues().select("id", ad.postcode(a).alias("postcode"), ad.street_name(a).alias("street"))


# --- dedup, merge, work-lists -----------------------------------------------------------

@query("u01_first_seen", "select k, min(l_orderkey * 10 + l_linenumber) as first_ord from (select *, l_partkey % 500 as k from lineitem) group by 1")
def u01(t: Tables):
    rows = t.raw("lineitem").select(F.expr("l_partkey % 500").alias("k"), F.expr("l_orderkey * 10 + l_linenumber").alias("first_ord"))
    # equal order numbers are the same row, so the first one is well defined
    return mg.first_seen(rows, "first_ord", "k")


@query("u02_first_by_place", V + """select min(id) as id, lower(brand) as low_name, round_even(50.8::double + (id % 5) * 0.01::double, 4) as lat4, round_even(4.3::double + (id % 7) * 0.01::double, 4) as lng4
  from v group by 2, 3, 4""")
def u02(t: Tables):
    # brands on a coarse grid, so that many rows share a place
    rows = t.venues().select("id", F.col("brand").alias("name"), F.expr("50.8D + (id % 5) * 0.01D as lat"), F.expr("4.3D + (id % 7) * 0.01D as lng"))
    v = mg.first_by_place(rows, "id")
    return v.select("id", F.lower("name").alias("low_name"), F.bround("lat", 4).alias("lat4"), F.bround("lng", 4).alias("lng4"))


@query("u03_merge_new", """select p_partkey as id, p_name as name, false as is_new from part where p_size <= 25
  union all select s.k, 'entry ' || s.k::varchar, true from (select distinct l_partkey as k from lineitem) s
  left join (select p_partkey from part where p_size <= 25) p on p_partkey = s.k where p_partkey is null""")
def u03(t: Tables):
    old = t.raw("part").filter("p_size <= 25").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    new = t.raw("lineitem").select(F.col("l_partkey").alias("id"), F.concat(F.lit("entry "), F.col("l_partkey").cast("string")).alias("name"))
    return mg.merge_new(old, new)


@query("u04_upsert_newest", """select user_id, event_type, value, epoch_us(ts) as at_us from (
  select *, row_number() over (partition by user_id order by ts desc) as rn from events) where rn = 1""")
def u04(t: Tables):
    e = t.raw("events").select("user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    old, new = e.filter("event_type <> 'purchase'"), e.filter("event_type = 'purchase'")
    return mg.upsert(old, new, "user_id", "at_us")


_LOG = "log as (select user_id as key, epoch_us(ts) as ts, event_type = 'purchase' as ok, 'code ' || floor(value)::int::varchar as error from events where event_type in ('error', 'purchase'))"


def attempt_log(t: Tables):
    return t.raw("events").filter("event_type in ('error', 'purchase')").select(
        F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), (F.col("event_type") == "purchase").alias("ok"),
        F.concat(F.lit("code "), F.floor("value").cast("int").cast("string")).alias("error"))


_STATUS = _LOG + """,
 last_ok as (select key, max(ts) filter (where ok) as ok_at from log group by 1),
 status as (select key, bool_or(ok_at is not null) as completed,
   count(*) filter (where not ok and (ok_at is null or ts > ok_at)) as attempts,
   min(ts) filter (where not ok and (ok_at is null or ts > ok_at)) as first_failed_at,
   max(ts) filter (where not ok and (ok_at is null or ts > ok_at)) as last_failed_at,
   arg_max(error, ts) filter (where not ok and (ok_at is null or ts > ok_at)) as last_error,
   case when bool_or(ok_at is not null) then 'completed' else 'failed' end as status
  from log join last_ok using (key) group by 1)"""


@query("u05_pending_worklist", S.with_(_STATUS) + """select c_custkey as id, c_name as name from customer
  left join status on key = c_custkey where key is null""")
def u05(t: Tables):
    status = mg.attempt_status(attempt_log(t))
    wanted = t.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    done = status.filter("status = 'completed'").select(F.col("key").alias("id"))
    failed = status.filter("status = 'failed'").select(F.col("key").alias("id"))
    return mg.pending(wanted, done, failed, key="id")


@query("u06_attempt_status", S.with_(_STATUS) + "select * from status")
def u06(t: Tables):
    return mg.attempt_status(attempt_log(t))


@query("u07_distinct_reviews", """select min(doc_id) as review_id, n_chars % 97 as venue_id from documents
  group by n_chars % 97, coalesce(source, ''), coalesce(text, '')""")
def u07(t: Tables):
    from savorgrid.operators.reviews import distinct_reviews

    return distinct_reviews(t.doc_reviews(), "review_id").select("review_id", "venue_id")


@query("j22_refresh_hours", S.with_(S.V, S.PERIODS) + """select v.id, v.id % 3 = 0 as hours_updated,
  case when v.id % 3 = 0 then '1=23:59' else coalesce(closing, '') end as closing_times from v left join close_map using (id)""")
def j22(t: Tables):
    have = t.places().withColumn("closing_times", F.expr("case when id % 3 = 0 then null else closing_times end"))
    fetched = t.venues().select("id", "opening_hours", F.expr("map(1, '23:59')").alias("closing_times"), F.expr("array(1)").alias("days_open"))
    out = mg.refresh_hours(have, fetched)
    pairs = F.transform(F.array_sort(F.map_entries("closing_times")), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"]))
    return out.select("id", "hours_updated", F.array_join(pairs, ",").alias("closing_times"))


