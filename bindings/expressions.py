"""Venue-like columns derived from the driver's tables.

Every entry is one SQL expression that both Spark and DuckDB accept, so the Spark side and
the check side start from the same rows. Nothing here filters rows.
"""

from __future__ import annotations


def d(x: float) -> str:
    """A double literal for both engines."""
    return f"cast({x} as double)"


BASE = "concat(p_name, ' ', lower(p_type))"

VENUE = {
    "id": "p_partkey",
    "name": f"""case p_partkey % 12
        when 0 then concat('Chez ', {BASE}) when 1 then concat({BASE}, ' Bar')
        when 2 then concat('Café ', {BASE}) when 3 then concat({BASE}, ' 🇹🇷')
        when 4 then concat('Şile ', {BASE}) when 5 then concat('Friture ', {BASE})
        when 6 then concat({BASE}, ' | best near - top - of the old town, ten minutes from the market square')
        when 7 then concat('Maison de ', {BASE}) when 8 then concat('Le ', {BASE}, ' Kitchen')
        when 9 then concat('Phở Mama ', {BASE}) when 10 then {BASE}
        else concat('L''', {BASE}) end""",
    "address": """case when p_partkey % 29 = 0 then null when p_partkey % 31 = 0 then ''
        else concat(case p_partkey % 3 when 0 then 'Rue ' when 1 then 'Chau. de ' else 'Avenue ' end,
        p_type, ' ', cast(p_size as varchar(9)), ', ', cast(1000 + 10 * (p_partkey % 22) as varchar(9)), ' City') end""",
    "lat": f"{d(50.76)} + ((p_partkey * 7919) % 1500) / {d(10000)}",
    "lng": f"{d(4.26)} + ((p_partkey * 104729) % 2200) / {d(10000)}",
    "rating": f"cast(30 + ((p_partkey * 13) % 21) as double) / {d(10)}",
    "review_count": "coalesce(q, 0)",
    "price_level": """case p_partkey % 6 when 0 then 'PRICE_LEVEL_FREE' when 1 then 'PRICE_LEVEL_INEXPENSIVE'
        when 2 then 'PRICE_LEVEL_MODERATE' when 3 then 'PRICE_LEVEL_EXPENSIVE'
        when 4 then 'PRICE_LEVEL_VERY_EXPENSIVE' else null end""",
    "types_csv": """case p_partkey % 7 when 0 then 'point_of_interest,greek_restaurant,bar' when 1 then 'bar,food'
        when 2 then 'food,cafe' when 3 then 'store' when 4 then 'food,meal_takeaway' when 5 then 'italian_restaurant,food'
        else 'food,bakery' end""",
    "primary_type": """case p_type when 'ECONOMY' then 'fast_food_restaurant' when 'SMALL' then 'cafe'
        when 'LARGE' then 'turkish_restaurant' when 'MEDIUM' then 'belgian_restaurant'
        when 'STANDARD' then case p_partkey % 5 when 0 then 'wine_bar' when 1 then 'point_of_interest' else 'lebanese_restaurant' end
        else case p_partkey % 9 when 0 then 'hotel' when 1 then 'gas_station' when 2 then 'sandwich_shop'
             when 3 then 'supermarket' when 4 then 'store' else null end end""",
    "price_eur": f"(p_retailprice - {d(900)}) * {d(0.8)}",
    "residual": f"cast((p_partkey * 37) % 141 - 70 as double) / {d(100)}",
    "brand": "p_brand",
    "size": "p_size",
    "languages_csv": "case p_partkey % 4 when 0 then 'tr' when 1 then 'en' when 2 then 'fr' else 'ar' end",
}

VENUE_SOURCE = """part left join (
    select l_partkey, cast(floor(sum(l_quantity) * ((l_partkey % 11) * (l_partkey % 11) + 1) / 50) as bigint) as q
    from lineitem group by l_partkey) r on p_partkey = l_partkey"""

DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

_STYLES = [
    "11:30 AM – 2:00 PM, 6:30 – 10:00 PM",
    "12:00 – 2:00 PM",
    "5:00 PM – 1:30 AM",
    "Open 24 hours",
    "9:00 AM — 5:00 PM",
    "10:00 – 2:00 AM",
    "12:00 AM – 12:30 AM, 11:00 AM – 11:30 PM",
]


def is_open(day: str) -> str:
    """Open on 0=Monday .. 6=Sunday."""
    return f"(p_partkey + {day}) % 5 <> 0 and (p_partkey % 17 <> 0 or {day} in (0, 1, 2, 3))"


def hours_text(day: int) -> str:
    """One day's line; the whole list is null where p_partkey % 8 = 7."""
    styles = " ".join(
        f"when {i} then '{DAYS[day]}: {s}'" for i, s in enumerate(_STYLES)
    )
    return f"case when {is_open(str(day))} then case p_partkey % 8 {styles} end else '{DAYS[day]}: Closed' end"


# Structured periods: place days run 0=Sunday .. 6=Saturday.
MAIN_OPEN = "9 + p_size % 4"
MAIN_CLOSE = "13 + p_size % 4 + p_partkey % 14"  # from 24 on it is the next day
SECOND_OPEN, SECOND_CLOSE, SECOND_MINUTE = "18", "22", "30"
HAS_SECOND = "p_partkey % 4 = 0"

# External records: one next to each venue, some near enough to be the same place.
EXTERNAL = {
    "ext_id": "1000000 + id",
    "name": """case id % 4 when 0 then concat('zz ', name) when 1 then concat(name, ' bar')
        when 2 then concat(upper(substring(name, 1, 1)), substring(name, 2)) else concat('new ', name) end""",
    "lat": f"lat + ((id % 13) - 6) * {d(0.0002)}",
    "lng": f"lng + ((id % 7) - 3) * {d(0.0002)}",
    "cuisine_tag": """case id % 6 when 0 then 'pizza;italian' when 1 then 'turkish' when 2 then 'kebab'
        when 3 then 'sandwich;bread' when 4 then '' else 'coffee_shop' end""",
    "amenity": "case id % 5 when 0 then 'fast_food' when 1 then 'cafe' else 'restaurant' end",
    "street": "case when id % 9 = 0 then null else concat('Street ', brand) end",
    "house": "case when id % 4 = 0 then null else cast(size as varchar(9)) end",
    "postcode": "case when id % 10 = 0 then null else cast(1000 + 10 * (id % 22) as varchar(9)) end",
    "is_way": "id % 3 = 1",
    "outdoor": "case id % 3 when 0 then 'yes' when 1 then 'no' else null end",
    "wheelchair": "case id % 4 when 0 then 'yes' when 1 then 'limited' else null end",
    "vegan": "case id % 5 when 0 then 'yes' when 1 then 'only' when 2 then 'no' else null end",
    "vegetarian": "case id % 6 when 0 then 'yes' when 1 then 'only' else null end",
    "halal": "case id % 7 when 0 then 'yes' else null end",
}

# Price list and register: one entry per supplier, written like the venue with that number.
PRICE_LIST = {
    "entry": "s_suppkey",
    "name": """case s_suppkey % 4 when 0 then concat('Restaurant ', name) when 1 then name
        when 2 then replace(name, 'e', '') else concat(s_name, ' grill') end""",
    "address": "case when s_suppkey % 5 = 0 then '' else replace(coalesce(address, ''), 'Avenue', 'Av.') end",
    "average_price": f"case when s_suppkey % 7 = 0 then null else cast(8 + s_suppkey % 71 as double) end",
    "thefork_rating": f"case when s_suppkey % 6 = 0 then null else cast(60 + s_suppkey % 40 as double) / {d(10)} end",
    "thefork_url": "case when s_suppkey % 3 = 0 then null else concat('https://prices.example/', cast(s_suppkey as varchar(9))) end",
}

REGISTER = {
    "reg_id": "concat('R', cast(s_suppkey as varchar(9)))",
    "ord": "s_suppkey",
    "name": "case s_suppkey % 3 when 0 then concat(name, ' sprl') when 1 then upper(name) else concat('NV ', name) end",
    "street": """case s_suppkey % 3 when 0 then 'Rue ' when 1 then 'Chau. de ' else 'Avenue ' end || coalesce(btype, '')""",
    "house_nr": "cast(size as varchar(9))",
    "postcode": "cast(1000 + 10 * (s_suppkey % 22) as varchar(9))",
    "municipality": "concat('Town ', cast(s_nationkey as varchar(9)))",
    "code": "'S1'",
    "valid_until": "'2027-01-01'",
}
VENUE["btype"] = "p_type"

REVIEW_DOC = {
    "review_id": "doc_id",
    "venue_id": "n_chars % 97",
    "text": "text",
    "declared": "case when doc_id % 4 = 0 then null else lang end",
    "reviewer_name": "source",
    "rating": "cast(1 + doc_id % 5 as int)",
}

REVIEW_LINE = {
    "venue_id": "l_partkey",
    "rating": "cast(1 + cast(l_quantity as int) % 5 as int)",
    "reviewer": "l_suppkey",
    "is_local_guide": "(l_linenumber + l_partkey) % 3 = 0",
    "reviewer_review_count": "case when l_orderkey % 6 = 0 then null else cast(l_orderkey % (l_partkey % 50 + 10) as int) end",
    "date": """case when (2001 - year(l_shipdate)) = 1 then 'a year ago'
        when (2001 - year(l_shipdate)) = 0 then '3 months ago'
        else concat(cast((2001 - year(l_shipdate)) * (l_partkey % 3 + 1) as varchar(9)), ' years ago') end""",
}
