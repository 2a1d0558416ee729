"""Rules at their boundaries."""

import math

import pytest
from pyspark.sql import functions as F

from savorgrid.functions import address as ad
from savorgrid.functions import hours as hr
from savorgrid.functions import money as mo
from savorgrid.functions import numeric as nu
from savorgrid.functions import text as tx
from savorgrid.functions.geo import HexGrid, RadiusCells, haversine_km
from savorgrid.operators import ingest as ing
from savorgrid.plans import score as sc


def test_confidence(values):
    got = values([0, 5, 9, 10, 50, 200, 500], "bigint", lambda c: nu.confidence(F.col(c)))
    want = [0.3 * n / 10 if n < 10 else 1 - 1 / math.sqrt(1 + n / 50) for n in (0, 5, 9, 10, 50, 200, 500)]
    assert got == pytest.approx(want)


def test_review_adjustment_bands(values):
    ns = [0, 24, 25, 150, 151, 600, 601, 1200, 1201, 5000]
    calm = values(ns, "bigint", lambda c: sc.review_adjustment(F.col(c), F.lit(False), F.lit("local_foodie")))
    busy = values(ns, "bigint", lambda c: sc.review_adjustment(F.col(c), F.lit(False), F.lit("mixed")))
    fry = values(ns, "bigint", lambda c: sc.review_adjustment(F.col(c), F.lit(True), F.lit("mixed")))

    def sig(x, c, s):
        return 1 / (1 + math.exp(-s * (x - c)))

    assert calm[0] == pytest.approx(-0.30 * (1 - sig(0, 15, 0.2)))
    assert calm[2] == pytest.approx(0.05 * math.exp(-(50**2) / 3200))
    assert calm[4] == pytest.approx(0.05 * math.exp(-(149**2) / 45000))
    assert calm[6] == pytest.approx(0.02 * (1 - sig(601, 900, 0.005)))
    assert calm[8] == pytest.approx(-0.03 * sig(1201, 2000, 0.001))
    assert busy[9] == pytest.approx(-0.08 * sig(5000, 1500, 0.002))
    assert fry[8:] == [0.0, 0.0]


def test_review_scarcity_and_low_review(values):
    ns = [34, 35, 49, 50, 200, 201, 500, 501, 1000, 1001]
    got = values(ns, "bigint", lambda c: sc.review_scarcity(F.lit(4.0), F.col(c)))
    assert got == pytest.approx([0, 0.3, 0.3 + 0.6 * 14 / 15, 1, 1, 0.7, 0.7, 0.3, 0.3, 0])
    rs = [3.9, 4.0, 4.5, 4.8, 5.0]
    low = values(rs, "double", lambda c: sc.low_review_penalty(F.lit(100), F.col(c), nu.confidence(F.lit(100))))
    lack = 1 / math.sqrt(3)
    assert low == pytest.approx([-0.15 * lack * e for e in (0, 0.2, 0.5, 0.8, 1.0)])


def test_price_rules(values):
    assert values(["PRICE_LEVEL_FREE", "3", None, "odd"], "string", lambda c: mo.price_number(F.col(c))) == [0, 3, 2, 2]
    assert values([14.99, 15.0, 30.0, 60.0, None], "double", lambda c: mo.price_band(F.col(c))["level"]) == [1, 2, 3, 4, None]
    assert values([1.0, 4.5, 4.2, 4.1], "double", lambda c: sc.value_bonus(F.lit(1), F.col(c))) == [0, 0.04, 0.02, 0]


def test_schedule_texts(values):
    days = [
        ["Monday: 11:30 AM – 2:00 PM, 5:00 PM – 1:00 AM"] * 3,
        ["Tuesday: Closed", "Wednesday: 12:00 – 2:00 PM, 6:30 – 10:00 PM", "Thursday: Open 24 hours"],
        [f"{d}: 10:00 AM — 5:00 PM" for d in "ABCD"],
        [],
    ]
    got = values(days, "array<string>", lambda c: hr.schedule(F.col(c)))
    assert (got[0].days_open, got[0].total_hours_per_week, got[0].latest_close_hour, got[0].closes_late) == (3, 33, 1, True)
    assert (got[1].days_open, got[1].total_hours_per_week, got[1].has_split_service) == (2, 6, False)
    assert (got[2].is_lunch_only, got[2].total_hours_per_week) == (True, 28)
    assert (got[3].days_open, got[3].parsed) == (0, True)
    assert values([None], "array<string>", lambda c: hr.schedule(F.col(c)))[0].parsed is False


def test_rhythm_prefers_the_higher_and_lark_on_a_tie(values):
    late = [f"{d}: 6:00 PM – 2:00 AM" for d in "ABCD"]  # 32 hours on four days: lark 0.6, owl 0.8
    short = [f"{d}: 11:00 PM – 1:00 AM" for d in "ABC"]  # six hours: lark 0.8, owl 0.8
    got = values([late, short], "array<string>", lambda c: hr.rhythm_bonus(F.lit(4.0), hr.schedule(F.col(c))))
    assert [(g.score, g.kind) for g in got] == [(0.8, "owl"), (0.8, "lark")]
    assert values([late], "array<string>", lambda c: hr.rhythm_bonus(F.lit(3.9), hr.schedule(F.col(c))))[0].kind is None


def test_open_on(values):
    rows = [None, [], ["Monday: Closed"], ["Monday: 9 AM – 5 PM"], ["Friday: 9 AM – 5 PM"]]
    assert values(rows, "array<string>", lambda c: hr.open_on(F.col(c), "Monday")) == [True, True, False, True, False]


def test_weekday_close_takes_the_upper_median(values):
    rows = [{1: "20:00", 2: "22:00", 3: "21:30", 4: "23:00"}, {6: "20:00"}, {1: "12:00"}, {1: "bad"}]
    got = values(rows, "map<int,string>", lambda c: hr.weekday_close(F.col(c)))
    assert [(g.early, g.hour) for g in got] == [(False, 22), (False, None), (False, 12), (False, None)]


def test_name_forms(values):
    assert values(["Chez L'Ami  Bar", "CAFÉ-Bar Corné"], "string", lambda c: tx.normalise_quotes(F.col(c))) == ["chez lami bar", "café bar corné"]
    assert values(["Le Coq Bar Café", "Mia Bistro!"], "string", lambda c: tx.normalise_endings(F.col(c))) == ["le coq", "mia bistro"]
    assert values(["Café Corné SPRL", "NV Old Town"], "string", lambda c: tx.normalise_company(F.col(c))) == ["corné", "old town"]
    assert values(["L'Étoile de la Mer", "Bar the Barn"], "string", lambda c: tx.normalise_words(F.col(c))) == ["étoile mer", "barn"]
    assert values(["Crème Brûlée", "Şile"], "string", lambda c: tx.plain_name(F.col(c))) == ["creme brulee", "sile"]


def test_markers(values):
    got = values(["Şile Ocağı", "Phở Hà", "Müller", "Phở X", "Cafe"], "string", lambda c: tx.letter_marker(F.col(c)))
    assert [(g.has, g.category) for g in got] == [
        (True, "Turkish"), (True, "Vietnamese"), (True, "Turkish"), (True, "Vietnamese"), (False, None)
    ]
    flags = values(["Grill 🇧🇷", "Grill"], "string", lambda c: tx.flag_marker(F.col(c)))
    assert [(f.has, f.category) for f in flags] == [(True, "Brazilian"), (False, None)]


def test_languages(values):
    texts = ["", None, "مرحبا", "çok güzel", "Lekker gegeten", "très bon", "sehr gut", "the food", "xyz"]
    assert values(texts, "string", lambda c: tx.guess_language(F.col(c))) == ["unknown", "unknown", "ar", "tr", "nl", "fr", "de", "en", "other"]


def test_family_names(values):
    names = ["Chez Marie", "La Maison de Jo", "Au Vieux Four", "Bij Jef", "'t Hoekje", "Casa Nonna", "Chezz"]
    assert values(names, "string", lambda c: tx.family_pattern(F.col(c))) == ["chez", "maison", "au_tradition", "bij", "t_diminutive", "family_title", None]


def test_uncertainty(values):
    names = ["Best | Near", "x" * 81, "a - b - c", None]
    got = values(names, "string", lambda c: tx.reputation_uncertainty(F.col(c), F.lit(5.0), F.lit(201)))
    assert [round(g.score, 2) for g in got] == [0.73, 0.70, 0.48, 0.40]
    assert got[0].flags == ["seo_formatting", "promotional_name", "statistically_unlikely_perfect"]


def test_addresses(values):
    a = ["Rue des Sablons 11, 1000 Town", "Chau. de Waterloo 515, 1050 Town", "12, 1000", None]
    assert values(a, "string", lambda c: ad.street_label(F.col(c))) == ["Rue des Sablons", "Chau. de Waterloo", "12", "Unknown"]
    assert values(a, "string", lambda c: ad.street_name(F.col(c)))[:2] == ["Rue des Sablons", "Chau. de Waterloo"]
    assert values(a, "string", lambda c: ad.postcode(F.col(c))) == ["1000", "1050", "1000", None]


def test_osm_category(values):
    got = values(["pizza;italian", " Sushi", "fish_and_chips", "", None], "string", lambda c: ing.osm_category(F.col(c)))
    assert got == ["Italian", "Japanese", "Fish_And_Chips", "Restaurant", "Restaurant"]


def test_hex_round_trip(spark):
    grid = HexGrid(50.8467, 4.3525)
    df = spark.range(2000).selectExpr("50.76D + (id * 7919 % 1500) / 10000D as lat", "4.26D + (id * 104729 % 2200) / 10000D as lng")
    df = df.withColumn("cell", grid.cell(F.col("lat"), F.col("lng")))
    centre = grid.centre(F.col("cell"))
    again = df.withColumn("again", grid.cell(centre["lat"], centre["lng"])).withColumn("d", haversine_km(F.col("lat"), F.col("lng"), centre["lat"], centre["lng"]))
    assert again.filter("again <> cell").count() == 0
    assert again.agg(F.max("d")).first()[0] < grid.edge_km * 1.01


@pytest.mark.parametrize("lat0", [0.0, 50.8, -71.0])
def test_radius_cells_lose_no_pair(spark, lat0):
    cells = RadiusCells(100.0)
    pts = spark.range(400).selectExpr(
        "id", f"{lat0}D + (id * 7919 % 997) / 300000D as lat", "4.3D + (id * 104729 % 991) / 100000D as lng"
    )
    a = pts.withColumn("c", F.explode(cells.around(F.col("lat"), F.col("lng"))))
    b = pts.select(F.col("id").alias("id2"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"), cells.home(F.col("lat"), F.col("lng")).alias("c"))
    near = haversine_km(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")) < 0.1
    blocked = a.join(b, "c").filter(near).count()
    rows = pts.collect()

    def km(p, q):
        la, lb = math.radians(p.lat), math.radians(q.lat)
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(q.lng - p.lng) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    assert blocked == sum(km(p, q) < 0.1 for p in rows for q in rows)
