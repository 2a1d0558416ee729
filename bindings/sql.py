"""Building blocks of the check queries, in DuckDB's SQL."""

from __future__ import annotations

import math

from savorgrid.functions import text as tx
from savorgrid.functions import money
from savorgrid.operators import names as nm
from savorgrid.context import OSM_CATEGORIES

from . import expressions as X
from .tables import HEX, PACK


def q(s) -> str:
    """A literal."""
    if s is None:
        return "null"
    if isinstance(s, bool):
        return "true" if s else "false"
    if isinstance(s, (int, float)):
        return f"cast({s!r} as double)" if isinstance(s, float) else str(s)
    return "'" + str(s).replace("'", "''") + "'"


def values(name: str, cols: str, rows) -> str:
    body = ", ".join("(" + ", ".join(q(c) for c in r) + ")" for r in rows)
    return f"{name}({cols}) as (values {body})"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def half_even(x: str, places: int) -> str:
    """Half-even on the decimal value, after rounding noise away."""
    unit = 10.0 ** (9 - places)
    r = f"round(({x}) * 1e9)"
    q_ = f"floor({r} / {q(unit)})"
    rem = f"({r} - {q_} * {q(unit)})"
    up = f"({rem} > {q(unit / 2)} or ({rem} = {q(unit / 2)} and {q_}::bigint % 2 <> 0))"
    return f"(({q_} + (case when {up} then 1 else 0 end)) / {q(10.0 ** places)})"


def hav(a: str, b: str, c: str, d: str) -> str:
    h = (
        f"(pow(sin(radians({c}-({a}))/2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d}-({b}))/2), 2))"
    )
    return f"(2 * 6371.0::double * atan2(sqrt({h}), sqrt(1 - {h})))"


def any_contains(text: str, needles) -> str:
    return "(" + " or ".join(f"contains({text}, {q(n)})" for n in needles) + ")" if needles else "false"


def first_contains(text: str, rules) -> str:
    whens = " ".join(f"when {any_contains(text, ns)} then {q(lab)}" for lab, ns in rules)
    return f"(case {whens} end)"


def any_regex(text: str, patterns) -> str:
    return f"regexp_matches({text}, {q('|'.join('(?:' + p + ')' for p in patterns))})"


def phrase(text: str, needles) -> str:
    import re as _re

    return any_regex(text, [r"(^|[^a-z])" + _re.escape(n) + r"($|[^a-z])" for n in needles])


def case_map(value: str, mapping) -> str:
    whens = " ".join(f"when {q(k)} then {q(v)}" for k, v in mapping.items())
    return f"(case {value} {whens} end)"


def in_list(items) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


def lst(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def with_(*ctes: str) -> str:
    return "with recursive " + ",\n".join(c for c in ctes if c) + "\n"


# --- venues and their derivations -------------------------------------------------------

_COLS = ", ".join(f"{sql} as {c}" for c, sql in X.VENUE.items())
_HOURS = "[" + ", ".join(X.hours_text(i) for i in range(7)) + "]"
V = (
    f"v as (select {_COLS}, string_split({X.VENUE['types_csv']}, ',') as types, "
    f"case when p_partkey % 8 <> 7 then {_HOURS} end as opening_hours from {X.VENUE_SOURCE})"
)

_PLACE_DAY = "(dy.d + 6) % 7"
PERIODS = f"""
periods as (
  select p_partkey as id, dy.d as open_day, 1 as seq, {X.MAIN_OPEN} as open_h,
         (dy.d + case when {X.MAIN_CLOSE} >= 24 then 1 else 0 end) % 7 as close_day,
         ({X.MAIN_CLOSE}) % 24 as close_h, 0 as close_m
  from part, (select unnest(range(7)) as d) dy where {X.is_open(_PLACE_DAY)}
  union all
  select p_partkey, dy.d, 2, {X.SECOND_OPEN}, dy.d, {X.SECOND_CLOSE}, {X.SECOND_MINUTE}
  from part, (select unnest(range(7)) as d) dy where {X.is_open(_PLACE_DAY)} and {X.HAS_SECOND}),
open_days as (select id, list_sort(list(distinct open_day)) as days from periods group by id),
closes as (
  select id, close_day, arg_max(printf('%02d:%02d', close_h, close_m), open_day * 10 + seq) as close_at
  from periods group by id, close_day),
close_map as (select id, string_agg(close_day::varchar || '=' || close_at, ',' order by close_day) as closing from closes group by id),
close_median as (
  select id, hs[len(hs) // 2 + 1] as hour from (
    select id, list_sort(list(cast(substr(close_at, 1, 2) as int))) as hs from closes where close_day between 1 and 5 group by id))"""

_LAT0, _LNG0, _S = HEX.lat0, HEX.lng0, HEX.edge_km


def hex_cell(source: str, keep: str = "*") -> str:
    """select keep, cell from source; bigint cell of lat and lng."""
    x = f"(6371.0::double * radians(lng - {q(_LNG0)}) * {q(math.cos(math.radians(_LAT0)))})"
    y = f"(6371.0::double * radians(lat - {q(_LAT0)}))"
    return f"""select * exclude (fq, fr, q0, r0, s0, dq, dr, ds),
      (((case when dq > dr and dq > ds then -r0 - s0 else q0 end) + 1048576) * 2097152
       + (case when not (dq > dr and dq > ds) and dr > ds then -q0 - s0 else r0 end) + 1048576)::bigint as cell
      from (select *, abs(q0 - fq) as dq, abs(r0 - fr) as dr, abs(s0 - (-fq - fr)) as ds from (
        select *, floor(fq + 0.5) as q0, floor(fr + 0.5) as r0, floor((-fq - fr) + 0.5) as s0 from (
          select {keep}, ({q(math.sqrt(3) / 3)} * {x} - {y} / 3) / {q(_S)} as fq, ({q(2 / 3)} * {y}) / {q(_S)} as fr
          from {source})))"""


LOW = "lower(name)"
CHAIN = any_regex(LOW, PACK.chain_patterns)
SHOP = any_regex(LOW, PACK.shop_patterns)
_TYPED = f"list_filter(list_transform(types, lambda t: {case_map('t', PACK.type_categories)}), lambda c: c is not null)[1]"
CATEGORY = (
    f"coalesce({first_contains(LOW, PACK.category_overrides)}, {case_map('primary_type', PACK.type_categories)}, "
    f"{_TYPED}, {first_contains(LOW, PACK.category_keywords)}, 'Other')"
)


def _cap(k: str) -> str:
    return k.capitalize()


VENUE_TYPE = (
    "case when primary_type = 'sandwich_shop' then 'Sandwich_shop' when primary_type = 'fast_food_restaurant' then 'Fast_food' "
    + " ".join(f"when contains(primary_type, {q(k)}) then {q(_cap(k))}" for k in nm.VENUE_KINDS)
    + " "
    + " ".join(f"when list_contains(types, {q(k)}) then {q(_cap(k))}" for k in nm.VENUE_KINDS)
    + f" when {any_contains(LOW, nm.BAR_CUES)} and not {any_contains(LOW, ['restaurant', 'resto'])} then 'Bar' else 'Restaurant' end"
)
PRICE_NUM = (
    "case price_level "
    + " ".join(f"when {q(k)} then {v}" for k, v in money.PRICE_LEVELS.items())
    + " else 2 end"
)

BOX = PACK.box
OUTSIDE = f"not (lat between {q(BOX.lat_min)} and {q(BOX.lat_max)} and lng between {q(BOX.lng_min)} and {q(BOX.lng_max)})"
EXCLUDED = (
    f"({OUTSIDE} or coalesce({any_regex(LOW, PACK.excluded_names)}, false) "
    f"or coalesce(primary_type in {in_list(PACK.excluded_types)}, false))"
)

# venues with their row features, after cleaning
CLEAN = f"""clean as (
  select *, {CATEGORY} as category, {VENUE_TYPE} as venue_type, {PRICE_NUM} as price_numeric, {CHAIN} as is_chain,
         ln(1 + review_count) as log_review_count
  from v where lat is not null and lng is not null and rating is not null and not {EXCLUDED})"""
FEATURED = f"featured as ({hex_cell('clean')})"
CELLS = """
cat_counts as (select cell, category, count(*) as n from featured group by 1, 2),
cells as (select cell, count(*) as hex_restaurant_count, avg(rating) as hex_mean_rating,
          avg(is_chain::int) as hex_chain_share from featured group by 1),
entropy as (select cell, -sum(p * ln(p + 1e-10)) as hex_cuisine_entropy from (
  select cell, n / sum(n) over (partition by cell)::double as p from cat_counts) group by 1)"""

DISTRICTS = values(
    "districts", "ord, district, lat, lng, district_tier, fry, weight",
    [
        (i, x.name, x.lat, x.lng, x.tier, PACK.fry_shop_scores.get(x.name), PACK.tier_weights.get(x.tier, 0.0))
        for i, x in enumerate(PACK.districts)
    ],
)
QUARTERS = values(
    "quarters", "ord, quarter, lat, lng, quarter_tier, radius",
    [(i, x.name, x.lat, x.lng, x.tier, x.radius) for i, x in enumerate(PACK.quarters)],
)
STREETS = values(
    "streets", "ord, street, lat, lng, radius", [(i, x.name, x.lat, x.lng, x.radius) for i, x in enumerate(PACK.streets)]
)
_pairs: dict = {}
for _col, _m in ((0, PACK.affinity), (1, PACK.local_affinity)):
    for _c, _s2 in _m.items():
        for _d, _v in _s2.items():
            _pairs.setdefault((_c, _d), [None, None])[_col] = float(_v)
AFFINITY = values("affinity_dim", "category, district, community, local_score", [(c, dd, *x) for (c, dd), x in _pairs.items()])
CAT_STREETS = values(
    "cat_streets", "ord, category, street_name, district, lat, lng",
    [(i, s.category, s.name, s.district, s.lat, s.lng) for i, s in enumerate(PACK.category_streets)],
)
CAT_FACTS = values(
    "cat_facts", "category, rare, specificity, note",
    [
        (c, float(PACK.rare.get(c, 0.0)), float(PACK.specificity.get(c, 0.0)), PACK.community_notes.get(c))
        for c in dict.fromkeys([*PACK.rare, *PACK.specificity, *PACK.community_notes])
    ],
)

ZONED = f"""
{DISTRICTS}, {QUARTERS}, {STREETS},
near_district as (
  select id, district, district_tier, fry, dist as district_km from (
    select v.id, d.district, d.district_tier, d.fry, {hav('v.lat', 'v.lng', 'd.lat', 'd.lng')} as dist,
           row_number() over (partition by v.id order by round(pow({hav('v.lat', 'v.lng', 'd.lat', 'd.lng')}, 2), 9), d.ord) as rn
    from v, districts d) where rn = 1),
in_quarter as (
  select v.id, arg_min(z.quarter, z.ord) as quarter, arg_min(z.quarter_tier, z.ord) as quarter_tier
  from v, quarters z where {hav('v.lat', 'v.lng', 'z.lat', 'z.lng')} < z.radius group by v.id),
on_street as (
  select v.id, arg_min(z.street, z.ord) as street
  from v, streets z where {hav('v.lat', 'v.lng', 'z.lat', 'z.lng')} <= z.radius group by v.id),
zoned as (
  select v.*, d.district, d.district_tier, d.fry, k.quarter, k.quarter_tier, s.street,
         coalesce(k.quarter_tier, d.district_tier, 'mixed') as area_tier,
         {hav('v.lat', 'v.lng', *map(q, PACK.centre))} as centre_km,
         {hav('v.lat', 'v.lng', *map(q, PACK.office_hub))} as office_km,
         {CATEGORY} as category, {CHAIN} as is_chain, {PRICE_NUM} as price_numeric
  from v join near_district d using (id) left join in_quarter k using (id) left join on_street s using (id))"""

_STOP = lst(["", *PACK.stop_words])


def street_words(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({x}), '[()\\s]+', ' ', 'g'), ' '), lambda w: not list_contains({_STOP}, w))"


AFFINE = f"""
{AFFINITY}, {CAT_STREETS}, {CAT_FACTS},
known_cat as (select distinct category as c from affinity_dim where community is not null),
cat_words as (select category, list_distinct(flatten(list({street_words('street_name')}))) as words from cat_streets group by 1),
affine as (
  select z.*, a.community,
    greatest(coalesce(a.community, case when z.category in (select c from known_cat) then 0.2::double end, 0.0::double),
             coalesce(a.local_score, 0.0::double)) as affinity,
    coalesce(z.street is not null and list_has_any({street_words('z.street')}, w.words), false) as street_match,
    coalesce(f.rare, 0.0::double) as rare, coalesce(f.specificity, 0.0::double) as specificity, f.note
  from zoned z left join affinity_dim a on a.category = z.category and a.district = z.district
  left join cat_words w on w.category = z.category left join cat_facts f on f.category = z.category)"""

SHIFT = r"(\d{1,2}):?(\d{2})?\s*(AM|PM|am|pm)?\s*-\s*(\d{1,2}):?(\d{2})?\s*(AM|PM|am|pm)?"
_CLEAN_DAY = "replace(replace(replace(replace(t, chr(8239), ' '), chr(8201), ' '), chr(8211), '-'), chr(8212), '-')"
SCHEDULE = f"""
day_lines as (
  select id, i, opening_hours[i] as t from v, (select unnest(range(1, 8)) as i) where opening_hours is not null),
open_lines as (select id, i, {_CLEAN_DAY} as t from day_lines where not contains(t, 'Closed') and not contains(t, 'closed')),
raw_shifts as (
  select id, i, unnest(range(1, len(o) + 1)) as k, unnest(o)::int as o, unnest(om) as om, unnest(c)::int as c, unnest(cm) as cm
  from (select id, i, regexp_extract_all(t, {q(SHIFT)}, 1) as o, regexp_extract_all(t, {q(SHIFT)}, 3) as om,
               regexp_extract_all(t, {q(SHIFT)}, 4) as c, regexp_extract_all(t, {q(SHIFT)}, 6) as cm from open_lines)),
shifts as (
  select id, i, k, o2 as o, case when c2 < o2 then c2 + 24 else c2 end as c from (
    select id, i, k,
      case when om = 'PM' then case when o <> 12 then o + 12 else o end
           when om = 'AM' then case when o = 12 then 0 else o end
           when cm = 'PM' then case when o <> 12 then o + 12 else o end
           when cm = 'AM' then case when o >= 6 then o + 12 else o end else o end as o2,
      case when cm = 'PM' and c <> 12 then c + 12 when cm = 'AM' and c = 12 then 0 else c end as c2
    from raw_shifts)),
days as (
  select l.id, l.i, coalesce(sum(greatest(0, s.c - s.o)), 0) as hours, max(s.c) as latest,
         coalesce(bool_or(s.k = 1 and s.c between 13 and 16) and bool_or(s.k = 2 and s.o between 17 and 20), false) as split
  from open_lines l left join shifts s on s.id = l.id and s.i = l.i group by 1, 2),
schedule as (
  select v.id, count(d.i)::int as days_open, coalesce(sum(d.hours), 0)::int as total_hours_per_week,
    coalesce(max(case when d.latest > 24 then d.latest - 24 else d.latest end), 0)::int as latest_close_hour,
    count(*) filter (where d.split) >= 3 as has_split_service, count(*) filter (where d.latest >= 25) >= 3 as closes_late,
    count(*) filter (where d.latest <= 17) >= 4 and count(d.i) >= 4 as is_lunch_only,
    any_value(v.opening_hours is not null) as parsed
  from v left join days d using (id) group by v.id),
rhythm as (
  select id, case when ok then greatest(lark, owl) else 0.0::double end as rhythm_score,
    case when ok and lark > 0 and lark >= owl then 'lark' when ok and owl > 0 then 'owl' end as rhythm_kind
  from (select v.id, v.rating >= 4.0 and s.parsed as ok,
      case when has_split_service then 1.0::double
           when total_hours_per_week > 0 and total_hours_per_week < 30 then 0.8::double
           when is_lunch_only then 0.7::double when days_open between 1 and 4 then 0.6::double else 0.0::double end as lark,
      case when closes_late then 0.8::double else 0.0::double end as owl
    from v join schedule s using (id)))"""

FRY = any_contains(LOW, tx.FRY_SHOP_WORDS)
FAMILY = "(case " + " ".join(
    f"when regexp_matches(trim({LOW}), {q(rx)}) then {q(lab)}" for lab, rx in tx.FAMILY_NAMES
) + " end)"
STARS = (
    "coalesce(case " + " ".join(f"when {LOW} = {q(n)} then {s}" for n, s in PACK.star_exact.items()) + " end, case "
    + " ".join(f"when {phrase(LOW, [n])} then {s}" for n, s in PACK.star_names.items()) + " end, 0)"
)
BIB = phrase(LOW, PACK.bib_names)
GUIDE = f"({phrase(LOW, PACK.guide_names)} or {LOW} in {in_list(PACK.guide_exact)})"
PLAIN = f"strip_accents({LOW})"
INSTITUTION = "(case " + " ".join(
    f"when contains({LOW}, {q(k)}) or contains({PLAIN}, {q(k)}) then {q(float(s))}" for k, s in PACK.institutions.items()
) + " end)"


def sig(x: str, c: float, s: float) -> str:
    return f"(1 / (1 + exp(-{q(float(s))} * ({x} - {q(float(c))}))))"


def bell(x: str, c: float, w: float) -> str:
    return f"exp(-(({x} - {q(float(c))}) * ({x} - {q(float(c))})) / {q(2.0 * w * w)})"


CONF = "(case when review_count < 10 then 0.3::double * review_count / 10.0::double else 1 - 1 / sqrt(1 + review_count / 50.0::double) end)"
_N = "review_count"
ADJUST = f"""(case when {_N} < 25 then -0.30::double * (1 - {sig(_N, 15, 0.2)})
  when {_N} <= 150 then 0.05::double * {bell(_N, 75, 40)} when {_N} <= 600 then 0.05::double * {bell(_N, 300, 150)}
  when {_N} <= 1200 then 0.02::double * (1 - {sig(_N, 900, 0.005)})
  when category in ('Fast Food', 'Belgian') and {any_contains(LOW, [*tx.FRY_SHOP_WORDS, *PACK.known_fry_shops])} then 0.0::double
  when area_tier in ('local_foodie', 'diaspora_hub', 'underexplored') then greatest(-0.10::double, -0.03::double * {sig(_N, 2000, 0.001)})
  else greatest(-0.20::double, -0.08::double * {sig(_N, 1500, 0.002)}) end)"""
_ZONE = f"(coalesce(quarter in {in_list(PACK.crowd_quarters)}, false) or coalesce(quarter_tier = 'tourist_trap', false) or centre_km < 0.15)"
TRAP = f"""(case when not {_ZONE} then 0.0::double
  when {_N} > 1500 and rating < 4.3::double then least(1.0::double, 0.4::double + 0.3::double * (4.3::double - rating))
  when {_N} > 1500 then 0.15::double when rating < 4.3::double and centre_km < 0.1 then 0.2::double else 0.0::double end)"""
_PLACE = "lower(concat(name, ' ', address))"
BLOCKED = f"(trap > 0.3 or (rating > 0 and rating < 3.5) or coalesce(name <> '' and address <> '' and {any_contains(_PLACE, PACK.hall_words)}, false))"
RAW_COMMUNITY = "(case when affinity > 0 and street_match then least(1.0::double, affinity + 0.3::double) else affinity end)"
COMMUNITY = f"""(case when {BLOCKED} then 0.0::double else 0.07::double * ({RAW_COMMUNITY}
  * (case when {any_contains(LOW, PACK.hip_words)} then 0.3::double else 1.0::double end)
  * (case when price_numeric = 4 then 0.2::double else 1.0::double end)) end)"""
OFFICE = """(case when office_km <= 1.0 then -0.03::double * (1 - office_km) *
  (0.4::double * (case when price_numeric >= 3 then (price_numeric - 2) / 2.0::double else 0.0::double end) + 0.3::double)
  else 0.0::double end)"""
PRICE_QUALITY = """(case when rating > 0 and price_numeric = 4 and rating < 4.5::double then -0.10::double * (4.5::double - rating)
  when rating > 0 and price_numeric = 3 and rating < 4.3::double then -0.06::double * (4.3::double - rating) else 0.0::double end)"""
VALUE = """(case when price_numeric = 1 and rating >= 4.5 then 0.04::double when price_numeric = 1 and rating >= 4.2 then 0.02::double
  when price_numeric = 2 and rating >= 4.6 then 0.02::double when price_numeric = 2 and rating >= 4.4 then 0.01::double else 0.0::double end)"""
REVIEW_SCARCITY = f"""(case when rating < 4.0 then 0.0::double when {_N} between 50 and 200 then 1.0::double
  when {_N} > 200 and {_N} <= 500 then 0.7::double
  when {_N} >= 35 and {_N} < 50 then 0.3::double + 0.6::double * (({_N} - 35) / 15.0::double)
  when {_N} > 500 and {_N} <= 1000 then 0.3::double else 0.0::double end)"""
LOW_REVIEW = f"""(case when {_N} >= 200 then 0.0::double else -0.15::double * (1 - {CONF}) *
  (case when rating = 5.0 then 1.0::double when rating >= 4.8 then 0.8::double when rating >= 4.5 then 0.5::double
        when rating >= 4.0 then 0.2::double else 0.0::double end) end)"""
ICON = f"coalesce({INSTITUTION}, case when {FRY} then fry end, 0.0::double)"

PARTS = {
    "review_adjustment": "adjust",
    "base_quality": f"0.35::double * (rating / 5.0::double) * (0.5::double + 0.5::double * {CONF})",
    "residual_score": f"0.25::double * greatest(-1.0::double, least(1.0::double, residual * 2)) * {CONF}",
    "tourist_penalty": "-0.15::double * trap * (case when adjust >= 0 then 1.0::double else 0.5::double end)",
    "community_bonus": COMMUNITY,
    "independent_bonus": "case when is_chain then 0.0::double else 0.12::double end",
    "chain_penalty": "case when is_chain then -0.10::double else 0.0::double end",
    "rarity_bonus": "0.0::double",
    "office_penalty": OFFICE,
    "price_quality_penalty": PRICE_QUALITY,
    "value_bonus": VALUE,
    "scarcity_bonus": f"0.12::double * (0.70::double * {REVIEW_SCARCITY} + 0.20::double * rhythm_score + 0.10::double * rare)",
    "guide_bonus": "0.0::double",
    "mention_bonus": "0.0::double",
    "low_review_penalty": LOW_REVIEW,
    "family_bonus": f"case when {FAMILY} is not null and not is_chain then 0.02::double else 0.0::double end",
    "specificity_bonus": "0.01::double * specificity",
    "shop_penalty": f"case when {SHOP} then -0.80::double else 0.0::double end",
    "local_icon_bonus": f"0.05::double * {ICON}",
}
_PART_COLS = ", ".join(f"{sql} as c_{n}" for n, sql in PARTS.items())
_TOTAL = " + ".join(f"c_{n}" for n in PARTS)
SCORED_CTES = f"""
facts as (select a.*, r.rhythm_score, r.rhythm_kind, {ADJUST} as adjust, {TRAP} as trap from affine a join rhythm r using (id)),
parts as (select *, {_PART_COLS} from facts),
totals as (select *, greatest(0.0::double, least(1.0::double, {_TOTAL})) as raw_score from parts),
scored as (select *, raw_score as score, case when raw_score >= 0.55 then 'Gold' when raw_score >= 0.48 then 'Silver'
           when raw_score >= 0.30 then 'Bronze' else 'Unranked' end as tier from totals)"""
SCORED = [V, ZONED, AFFINE, SCHEDULE, SCORED_CTES]

EXTERNAL = "ext as (select " + ", ".join(f"{sql} as {c}" for c, sql in X.EXTERNAL.items()) + ", id from v)"


def osm_category(tag: str) -> str:
    tok = f"trim(split_part(coalesce({tag}, ''), ';', 1))"
    title = f"array_to_string(list_transform(string_split({tok}, '_'), lambda w: upper(w[1]) || lower(w[2:])), '_')"
    return f"coalesce({case_map(f'lower({tok})', OSM_CATEGORIES)}, case when {tok} = '' then 'Restaurant' else {title} end)"


def strip_(x: str) -> str:
    return f"trim({x})"


def norm_quotes(x: str) -> str:
    return f"trim(replace(replace(replace(lower({x}), '''', ''), '-', ' '), '  ', ' '))"


def norm_endings(x: str) -> str:
    out = f"trim(lower({x}))"
    for e in tx.NAME_ENDINGS:
        out = f"regexp_replace({out}, {q(e + '$')}, '')"
    return f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}} ]', '', 'g')"


_NOT_WORD = "[^\\p{L}\\p{N}_\\s]"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def norm_company(x: str) -> str:
    out = f"trim(lower({x}))"
    for w in tx.COMPANY_WORDS:
        out = f"replace(replace({out}, {q(' ' + w)}, ''), {q(w + ' ')}, '')"
    return squeeze(f"regexp_replace({out}, '{_NOT_WORD}', '', 'g')")


def norm_words(x: str) -> str:
    out = f"lower({x})"
    edge = r"[^\p{L}\p{N}_]"
    for w in tx.PRICE_LIST_WORDS:
        if w == "l'":
            out = f"regexp_replace({out}, {q('(^|' + edge + ')l' + chr(39) + r'([\p{L}\p{N}_])')}, '\\1\\2', 'g')"
        else:
            out = f"regexp_replace({out}, {q('(^|' + edge + ')' + w + '($|' + edge + ')')}, '\\1\\2', 'g')"
    return squeeze(f"regexp_replace({out}, '{_NOT_WORD}', '', 'g')")
