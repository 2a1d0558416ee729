"""Declared schemas of the tables that enter the jobs."""

from __future__ import annotations

PLACE = """
id string, name string, address string, lat double, lng double, rating double, review_count bigint,
price_level string, types array<string>, primary_type string, primary_type_display string,
website string, google_maps_url string, opening_hours array<string>, closing_times map<int,string>,
days_open array<int>
"""

PLACE_JSON = PLACE.replace("map<int,string>", "map<string,string>")

_MOMENT = "struct<day:int,hour:int,minute:int>"

PLACE_PAYLOAD = f"""
id string, displayName struct<text:string>, formattedAddress string,
location struct<latitude:double,longitude:double>, rating double, userRatingCount bigint,
priceLevel string, types array<string>, primaryType string, primaryTypeDisplayName struct<text:string>,
websiteUri string, googleMapsUri string,
regularOpeningHours struct<weekdayDescriptions:array<string>,
                           periods:array<struct<open:{_MOMENT},close:{_MOMENT}>>>
"""

OSM_ELEMENT = """
id bigint, type string, lat double, lon double, center struct<lat:double,lon:double>,
tags map<string,string>
"""

REVIEW_BUNDLE = """
name string, search_query string, scraped_at string,
metadata struct<price:string,rating:double,review_count:bigint,address:string>,
reviews array<struct<text:string,rating:int,date:string,reviewer_name:string,
                     is_local_guide:boolean,reviewer_review_count:int>>,
years_open string,
reviewer_quality struct<quality:string,local_guides_pct:int,avg_reviews:int>,
error string
"""

PRICE_LIST = """
name string, address string, average_price double, thefork_rating double, review_count bigint,
cuisine string, thefork_url string
"""

REGISTER_FIELDS = ["id", "name", "street", "house_nr", "postcode", "municipality", "code", "valid_until"]

MENTIONS = "name string, reddit_mentions bigint"

VALIDATION = """
name string, cuisine string, commune string, authenticity_score int, verdict string,
price_observed string, review_languages string, photo_quality string, owner_responds string,
families_visible string, menu_language string, years_open string, halal_certified string,
reservation_needed string, terrace_focus string, notes string
"""
