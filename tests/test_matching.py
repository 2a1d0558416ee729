"""Blocked and tiled matching against plain loops on small fixtures."""

import math
import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from savorgrid.operators import fuzzy as fz
from savorgrid.operators import reconcile as rc
from savorgrid.operators import similar as sm
from savorgrid.operators import zones as zn

WORDS = ["red", "blue", "gear", "ring", "bolt", "old", "mill", "café", "bar", "a", "ox"]


def metres(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def names(rng, n):
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n)]


@pytest.fixture(scope="module")
def places(spark):
    rng = random.Random(7)

    def table(n, offset):
        ns = names(rng, n)
        # a third of all rows are copies of one point, another part shares a name
        rows = []
        for i in range(n):
            hot = i % 3 == 0
            lat = 50.8 if hot else 50.8 + rng.random() * 0.004
            lng = 4.35 if hot else 4.35 + rng.random() * 0.006
            rows.append((offset + i, "" if i % 40 == 7 else ns[i], lat, lng))
        return rows

    v, e = table(240, 0), table(160, 1000)
    vdf = spark.createDataFrame(v, "id bigint, name string, lat double, lng double")
    edf = spark.createDataFrame(e, "ext_id bigint, name string, lat double, lng double")
    return v, e, vdf, edf


def test_match_by_place_equals_loop(places):
    v, e, vdf, edf = places

    def norm(s):
        for end in (" café", " bar"):
            s = s.removesuffix(end)
        return s

    # endings are cut in list order, each once
    def norm_all(s):
        for end in (" restaurant", " café", " cafe", " bar", " brasserie", " bistro", " kitchen"):
            s = s.removesuffix(end)
        return s

    want = {}
    for ext, n, lat, lng in e:
        hit = None
        for vid, vn, vlat, vlng in v:
            dist = metres((lat, lng), (vlat, vlng))
            if dist <= 100 and (norm_all(n) in norm_all(vn) or norm_all(vn) in norm_all(n) or dist < 30):
                hit = vid
                break
        want[ext] = hit
    for crowd in (rc.CROWD, 0):  # all cells met whole, all by name pieces
        got = {r.ext_id: r.match_id for r in rc.match_by_place(edf, vdf, crowd=crowd).collect()}
        assert got == want
    assert norm("a bar") == "a"


def test_match_by_name_then_place_equals_loop(places):
    v, e, vdf, edf = places
    want = {}
    for ext, n, lat, lng in e:
        near = [(vid, vn, metres((lat, lng), (a, b))) for vid, vn, a, b in v]
        first = [vid for vid, vn, dist in near if vn == n and dist < 100]
        second = [
            vid for vid, vn, dist in near
            if dist < 50 and (n in vn or vn in n or len(set(n.split()) & set(vn.split())) >= 2)
        ]
        want[ext] = (first or second or [None])[0]
    for crowd in (rc.CROWD, 0):
        got = {r.ext_id: r.match_id for r in rc.match_by_name_then_place(edf, vdf, crowd=crowd).collect()}
        assert got == want


def test_crowded_cells_and_empty_sides(spark):
    ddl = "id long, name string, lat double, lng double"
    words = ["Blue", "Fox", "Corner", "Bar", "Noodle"]
    rng = random.Random(5)
    # 200 venues of few names on one spot's cell, some without a name or a place
    v = [(i, " ".join(rng.sample(words, rng.randint(1, 3))), 50.8 + rng.random() * 3e-4, 4.3 + rng.random() * 3e-4) for i in range(200)]
    v += [(900, None, 50.8, 4.3), (901, "", 50.8001, 4.3001), (902, "Fox", None, 4.3)]
    e = [(1000 + i, " ".join(rng.sample(words, rng.randint(1, 3))), 50.8 + rng.random() * 3e-4, 4.3 + rng.random() * 3e-4) for i in range(60)]
    e += [(2000, None, 50.8, 4.3), (2001, "", 50.8, 4.3), (2002, "Fox", 50.8, None)]
    vdf = spark.createDataFrame(v, ddl)
    edf = spark.createDataFrame(e, ddl).withColumnRenamed("id", "ext_id")
    for match in (rc.match_by_place, rc.match_by_name_then_place):
        whole = sorted(match(edf, vdf, crowd=10_000).collect())
        assert len(whole) == len(e) and sum(r.match_id is not None for r in whole) >= 60
        assert sorted(match(edf, vdf).collect()) == whole
    assert rc.match_by_place(edf.limit(0), vdf).count() == 0
    assert all(r.match_id is None for r in rc.match_by_place(edf, vdf.limit(0)).collect())


def test_accept_new_equals_one_by_one(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["A", "b", "a"]), round(50.8 + rng.random() * 0.006, 5), round(4.3 + rng.random() * 0.006, 5)) for i in range(150)]
    rows += [(200 + i, "a", 50.8, 4.3) for i in range(60)]  # copies of one point
    known = [(1000 + i, "a", round(50.8 + rng.random() * 0.006, 5), 4.301) for i in range(5)]
    ddl = "id bigint, name string, lat double, lng double"
    taken = [k[1:] for k in known]
    want = []
    for i, n, lat, lng in rows:
        if not any(n.lower() == m.lower() and abs(lat - a) < 0.001 and abs(lng - b) < 0.001 for m, a, b in taken):
            want.append(i)
            taken.append((n, lat, lng))
    got = rc.accept_new(spark.createDataFrame(rows, ddl), spark.createDataFrame(known, ddl))
    assert sorted(r.id for r in got.collect()) == want


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


@pytest.fixture
def small_tiles(monkeypatch):
    """Hot tokens and names are spread even here, and the first bounds come from few names."""
    monkeypatch.setattr(sm, "HOT_ROWS", 5)
    monkeypatch.setattr(fz, "HOT_ROWS", 5)
    monkeypatch.setattr(fz, "SEEDS", 2)


def test_price_list_equals_loop(spark, small_tiles):
    rng = random.Random(5)
    vs = [(i, n, rng.choice(["Rue Haute 1", "Avenue Louise 22", "", "Place 5"])) for i, n in enumerate(names(rng, 120))]
    ps = [(i, n, rng.choice(["Rue Haute", "Av. Louise 22", ""])) for i, n in enumerate(names(rng, 30))]
    vdf = spark.createDataFrame(vs, "id bigint, name string, address string")
    pdf = spark.createDataFrame(ps, "entry bigint, name string, address string")
    forms = fz.normalise_words, fz.normalise_price_address
    vn = {r.id: (r.n, r.a) for r in vdf.select("id", forms[0](F.col("name")).alias("n"), forms[1](F.col("address")).alias("a")).collect()}
    pn = {r.entry: (r.n, r.a) for r in pdf.select("entry", forms[0](F.col("name")).alias("n"), forms[1](F.col("address")).alias("a")).collect()}
    want = {}
    for entry, (n, a) in pn.items():
        best, hit = 0.0, None
        for vid in sorted(vn):
            score = 0.7 * ratio(n, vn[vid][0]) + 0.3 * ratio(a, vn[vid][1])
            if n and n == vn[vid][0]:
                score = min(1.0, score + 0.2)
            if score > best and score >= 0.65:
                best, hit = score, vid
        if hit is not None:
            want[entry] = (hit, round(best, 9))
    got = {r.entry: (r.match_id, round(r.match_score, 9)) for r in fz.match_price_list(vdf, pdf).collect()}
    assert got == want and got


def test_register_cascade(spark, small_tiles):
    reg = [
        (1, "Old Mill sprl", "Rue Haute", "1000"),
        (2, "Corner Ring", "Rue Basse", "1010"),
        (3, "Corner Ring Zuid", "Avenue Noire", "1020"),
        (4, "Blue Gear Works", "Place Verte", "1030"),
        (5, "Zzz Qqq", "Quai 9 1040 x", "1040"),
    ]
    vs = [
        (1, "Old Mill", "Rue Haute 3, 1000 Town", 1.0),  # equal name, same postcode
        (2, "Old Mill", "Rue Haute 3, 1020 Town", 0.9),  # equal name, other postcode
        (3, "Corner Ring", "Rue Basse 4, 1010 Town", 1.0),  # two sites: the one in the street
        (4, "Corner Ring", "Rue Autre 4, 1050 Town", None),  # two sites: none fits
        (5, "Corner Ring", None, None),  # two sites and no address
        (6, "Blue Gear Work", "Place Verte 1, 1030 Town", ratio("blue gear work", "blue gear works") + 0.15),
        (7, "Nothing alike", "Rue Haute 3, 1000 Town", None),
        (8, "Zzz Krr", "Quai 9 1040 x", 0.9),  # same address key and half the name
    ]
    vdf = spark.createDataFrame([x[:3] for x in vs], "id bigint, name string, address string")
    rdf = spark.createDataFrame(reg, "ord bigint, name string, street string, postcode string")
    got = {r.id: r.confidence for r in fz.match_register(vdf, rdf).collect()}
    want = {x[0]: x[3] for x in vs if x[3] is not None}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    cover = fz.match_coverage(vdf, rdf, fz.match_register(vdf, rdf)).first()
    assert (cover.total_venues, cover.matches, cover.register_entries) == (8, len(want), 5)


def test_large_zone_joins_equal_loops(spark):
    rng = random.Random(11)
    zs = [(i, f"z{i}", 50.7 + rng.random() * 0.3, 4.2 + rng.random() * 0.4, 0.5 + (i % 4)) for i in range(40)]
    vs = [(i, 50.6 + rng.random() * 0.5, 4.0 + rng.random() * 0.8) for i in range(200)] + [(900, None, 4.0)]
    zdf = spark.createDataFrame(zs, "ord int, name string, lat double, lng double, radius double")
    vdf = spark.createDataFrame(vs, "id bigint, lat double, lng double")
    inside = {r.id: r.zone and r.zone.name for r in zn.containing_zone(vdf, zdf, 3.5).collect()}
    near = {r.id: r.zone and r.zone.name for r in zn.nearest_zone(vdf, zdf, 0.5).collect()}
    for vid, lat, lng in vs:
        if lat is None:
            assert inside[vid] is None and near[vid] is None
            continue
        dist = [(metres((lat, lng), (z[2], z[3])) / 1000, z) for z in zs]
        assert near[vid] == min(dist, key=lambda d: d[0])[1][1]
        assert inside[vid] == next((z[1] for d, z in dist if d < z[4]), None)
    odd = [(None, vs[0][1], vs[0][2], "a"), (None, vs[1][1], vs[1][2], "b"), (7, vs[2][1], vs[2][2], "c"), (7, vs[3][1], vs[3][2], "d"), (7, vs[3][1], vs[3][2], "d")]
    odf = spark.createDataFrame(odd, "id bigint, lat double, lng double, own string")  # null and repeated ids, a repeated row
    for found, want in ((zn.nearest_zone(odf, zdf, 0.5), near), (zn.containing_zone(odf, zdf, 3.5), inside)):
        assert found.columns == [*odf.columns, "zone"]
        assert sorted((r.own, r.zone and r.zone.name) for r in found.collect()) == [(x, want[i]) for x, i in zip("abcdd", (0, 1, 2, 3, 3), strict=True)]
    assert zn.nearest_zone(odf.where("false"), zdf).collect() == [] == zn.containing_zone(odf.where("false"), zdf, 3.5).collect()


def test_zones_that_cover_a_cell_hide_later_ones(spark):
    rng = random.Random(5)
    for mid in ((50.8, 4.3), (-72.0, 179.97), (89.6, 10.0)):  # the date line and a pole's neighbourhood too
        wide = 0.3 / math.cos(math.radians(mid[0]))
        turn = lambda x: (x + 180) % 360 - 180
        zs = [(i, f"z{i}", mid[0] + rng.uniform(-0.2, 0.2), turn(mid[1] + rng.uniform(-wide, wide)), rng.choice([0.0, 2.0, 8.0, 11.0])) for i in range(300)]
        vs = [(i, mid[0] + rng.uniform(-0.2, 0.2), turn(mid[1] + rng.uniform(-wide, wide))) for i in range(150)]
        zdf = spark.createDataFrame(zs + [(3, "a twin", *zs[3][2:])], "ord int, name string, lat double, lng double, radius double")
        got = {r.id: r.zone and (r.zone.ord, r.zone.name) for r in zn.containing_zone(spark.createDataFrame(vs, "id bigint, lat double, lng double"), zdf, 11.0).collect()}
        rows = [tuple(z) for z in zdf.collect()]
        for i, lat, lng in vs:
            assert got[i] == min(((z[0], z[1]) for z in rows if metres((lat, lng), (z[2], z[3])) < 1000 * z[4]), default=None)
        kept = zn._zone_cells(zdf, zn.RadiusCells(11000.0 / zn.FINE)).groupBy("_cell").count().agg(F.avg("count")).first()[0]
        assert kept < 20 or mid[0] > 89  # of 300 zones that overlap a hundredfold; no zone covers a cell around a pole


def test_files_are_not_broadcast_by_their_compressed_size(spark):
    rows = spark.range(3000).selectExpr("id", "'Same Long Name Of A Place' as name", "50.0D + id / 1000 as lat", "4.0D as lng")
    e = rc._collapse(rows, lambda c: c, "id", "e").drop("eord")
    v = rc._collapse(rows, lambda c: c, "id", "v")
    for pairs in (rc._near(e, v, 100.0, False, 64), rc._same_name(e, v, 100.0)):
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        assert not [x for x in plan.split("\n") if "BroadcastHashJoin" in x and "Inner" in x]


def test_string_ids_match_like_numbers(spark):
    venues = [(i, f"Le Petit Nom {i % 7}", f"Rue Haute {i % 5}, 1000") for i in range(40)]
    prices = [(i, f"Petit Nom {i % 7}", f"Rue Haute {i % 3}, 1000") for i in range(12)]
    ddl = "name string, address string"
    numbers = fz.match_price_list(
        spark.createDataFrame(venues, "id bigint, " + ddl), spark.createDataFrame(prices, "entry bigint, " + ddl)
    ).collect()
    texts = fz.match_price_list(
        spark.createDataFrame([(f"place-{i:03d}", n, a) for i, n, a in venues], "id string, " + ddl),
        spark.createDataFrame([(f"e{i}", n, a) for i, n, a in prices], "entry string, " + ddl),
    ).collect()
    assert numbers
    assert {(f"e{r.entry}", f"place-{r.match_id:03d}", r.match_score) for r in numbers} == {tuple(r.asDict()[c] for c in ("entry", "match_id", "match_score")) for r in texts}


LETTERS = "abcdeé 日"


def random_texts(rng, n):
    base = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 14))) for _ in range(n)]
    edited = []
    for t in base:
        t = list(t)
        for _ in range(rng.randint(0, 3)):
            t[rng.randint(0, len(t)) : rng.randint(0, len(t))] = rng.choice(LETTERS)
        edited.append("".join(t))
    return sorted(set(base + edited + ["", "a", "ab"]))


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_texts_loses_no_pair(spark, small_tiles, seed):
    rng = random.Random(seed)
    left, right = [(t, rng.choice([0.5, 0.6, 0.7, 0.85, 0.9, 1.0])) for t in random_texts(rng, 60)], random_texts(rng, 60) + ["x" * 300 + "ab"]
    left += [("x" * 290 + "ba", 0.8)]
    got = sm.similar_texts(spark.createDataFrame(left, "n string, t double"), spark.createDataFrame([(t,) for t in right], "m string"), both=True).collect()
    want = {}
    for n, t in left:
        for m in right:
            pair = tuple(r if r >= t - 1e-9 else None for r in (ratio(n, m), ratio(m, n)))
            if pair != (None, None):
                want[n, m] = pair
    assert {(r.n, r.m): (r.ratio, r.back) for r in got} == want and len(got) == len(want)


def test_containing_texts_loses_no_pair(spark, small_tiles):
    rng = random.Random(4)
    inner, outer = random_texts(rng, 80), random_texts(rng, 80) + ["abcde" * 9]
    got = sm.containing_texts(spark.createDataFrame([(t,) for t in inner], "x string"), spark.createDataFrame([(t,) for t in outer], "y string")).collect()
    assert sorted((r.x, r.y) for r in got) == sorted((x, y) for x in inner for y in outer if x in y)


def register_by_hand(vs, reg):
    """The cascade one venue after the other, on normalised texts."""
    out = {}
    for vid, n, code, street, whole in vs:
        similar = [e for e in reg if e[1] in n or n in e[1] or ratio(e[1], n) >= 0.7]
        if len(similar) > 1:
            hits = [e[0] for e in similar if code and e[3] == code and ratio(street, e[2]) >= 0.6]
            if hits:
                out[vid] = (1.0, min(hits))
            continue
        if similar and n and similar[0][1] == n:
            out[vid] = (1.0 if not code or similar[0][3] == code else 0.9, similar[0][0])
            continue
        near = [(-(ratio(n, e[1]) + (0.15 if code and e[3] == code else 0.0)), e[0]) for e in reg if e[1]]
        near = min([x for x in near if -x[0] >= 0.85], default=None)
        at = [e[0] for e in reg if code and e[3] == code and e[2] == whole and ratio(n, e[1]) >= 0.5]
        if near:
            out[vid] = (round(-near[0], 9), near[1])
        elif at:
            out[vid] = (0.9, min(at))
    return out


def test_register_equals_loop(spark, small_tiles):
    rng = random.Random(8)
    words = ["Gear", "Ring", "Bolts", "Old", "Mill", "Quai", "Zest", "Xylo", "Fjord", "Wok"]
    streets = ["Rue Haute", "Rue Hautes", "Avenue Noire", "Place 5"]
    def name():
        return " ".join(rng.choice(words) + rng.choice(["", "", "s", "xq", "yy"]) for _ in range(rng.randint(1, 3)))

    reg = [(i, name(), rng.choice(streets), rng.choice(["1000", "1010", None])) for i in range(40)]
    vs = [(i, "" if i == 7 else None if i == 8 else name(), rng.choice([None, "", *(f"{s} {k}, {c} Town" for s in streets for k in (1, 2) for c in (1000, 1010))])) for i in range(150)]
    vs += [(200 + i, reg[i][1], f"{reg[i][2]} 3, {reg[i][3]} Town") for i in range(30)]
    vdf = spark.createDataFrame(vs, "id bigint, name string, address string")
    rdf = spark.createDataFrame(reg, "ord bigint, name string, street string, postcode string")
    address = F.nullif(F.col("address"), F.lit(""))
    plain = vdf.select(
        "id", fz.normalise_company(F.col("name")), fz.postcode(address), fz.normalise_register_street(fz.street_name(address)), fz.normalise_register_street(address)
    ).collect()
    entries = rdf.select("ord", fz.normalise_company(F.col("name")), fz.normalise_register_street(F.col("street")), "postcode").collect()
    want = register_by_hand([tuple("" if x is None and i != 2 else x for i, x in enumerate(r)) for r in plain], [tuple(r) for r in entries])
    got = {r.id: (round(r.confidence, 9), r.register_ord) for r in fz.match_register(vdf, rdf).collect()}
    assert got == want and len(want) > 20


def test_blocks_let_few_dissimilar_texts_through():
    from savorgrid.functions.similarity import common_letters, common_sequence

    rng = random.Random(6)
    xs, ys = random_texts(rng, 80) + ["é" * 70 + "ab"], random_texts(rng, 80) + ["ab" + "é" * 90]
    both = common_letters(xs, ys)
    assert all(both[i, j] == sum((Counter(x) & Counter(y)).values()) for i, x in enumerate(xs) for j, y in enumerate(ys))
    i, j = (k.ravel() for k in np.indices((len(xs), len(ys))))
    for a, b, most in zip(i, j, common_sequence(xs, ys, i, j), strict=True):
        assert most >= sum(k.size for k in SequenceMatcher(None, xs[a], ys[b]).get_matching_blocks())
    # the same letters in another order: only the sequence tells them apart
    left = ["".join(rng.sample("abcdefghijklmnopqrst", 20)) for _ in range(200)]
    met = sm._close_in_block(pd.DataFrame({"n": left, "t": 0.7}), pd.DataFrame({"m": left}))
    assert set(zip(left, left, strict=True)) <= set(zip(met["n"], met["m"], strict=True)) and len(met) < 500


def test_price_list_meets_only_names_that_could_win(spark, monkeypatch):
    """Copies of an entry are matched once, and an address under a similar name bounds which other names are met."""
    rng = random.Random(9)
    words = ["gear", "ring", "bolt", "mill", "quai", "zest", "wok", "fjord"]
    ns = sorted({" ".join(rng.sample(words, 4)) for _ in range(60)})
    vs = [(i, ns[i % len(ns)], f"Rue Haute {i % 25}" if i % 6 else None) for i in range(600)]
    ps = [(i, ns[i % 20].replace("e", ""), f"Rue Haute {i % 25}" if i % 5 else "") for i in range(300)] + [(900, ns[3], "Rue Haute 4"), (901, None, "x")]
    rows = []
    met = fz._best_venues
    monkeypatch.setattr(fz, "_best_venues", lambda r, *rest: (rows.append(r.count()), met(r, *rest))[1])
    got = fz.match_price_list(spark.createDataFrame(vs, "id bigint, name string, address string"), spark.createDataFrame(ps, "entry bigint, name string, address string")).collect()
    assert len(got) == 301 and max(rows) < 301 * 3  # of 60 names
    forms = {a: a.lower().replace("rue", "r") if a else "" for a in {x[2] for x in vs + ps}}
    for r in got:
        _, n, a = next(p for p in ps if p[0] == r.entry)
        best = (0.0, 0)
        for vid, m, b in vs:
            s = 0.7 * ratio(n, m) + 0.3 * ratio(forms[a], forms[b])
            best = max(best, (min(1.0, s + 0.2) if n == m else s, -vid))
        assert (r.match_id, r.match_score) == (-best[1], pytest.approx(best[0]))


@pytest.mark.parametrize("lat0, lng0", [(0.0, 4.3), (50.8, 179.999), (-89.2, -179.999), (88.9985, 20.0), (89.9995, 0.0)])
def test_records_around_a_place_are_written_a_few_times(spark, lat0, lng0):
    rng = random.Random(3)
    spread = 0.004 / max(math.cos(math.radians(lat0)), 0.01)

    def rows(n):
        points = [(min(lat0 + rng.uniform(-0.002, 0.002), 90.0), lng0 + rng.uniform(-spread, spread)) for _ in range(n)]
        return [(i, names(rng, 1)[0], lat, (lng + 180) % 360 - 180) for i, (lat, lng) in enumerate(points)]

    small, large = rows(60), rows(150)
    s, t = (spark.createDataFrame(x, "ext_id bigint, name string, lat double, lng double") for x in (small, large))
    for mine, theirs, a, b in ((s, t, small, large), (t, s, large, small)):
        e = mine.selectExpr("name as en", "lat as elat", "lng as elng")
        v = theirs.selectExpr("name as vn", "lat as vlat", "lng as vlng", "ext_id as vord")
        sides = rc._tiled(e, v, 50.0)
        written = {len(x): side.count() for x, side in zip((a, b), sides, strict=True)}
        assert written[150] == 150
        if abs(lat0) < 60:  # nine times before
            assert 60 <= written[60] <= 3 * 60
        got = {(r.elat, r.elng, r.vlat, r.vlng) for r in rc._met(e, v, 50.0).collect()}
        assert {(p[2], p[3], q[2], q[3]) for p in a for q in b if metres(p[2:], q[2:]) < 50} <= got
    matched = rc.match_by_name_then_place(s, t.withColumnRenamed("ext_id", "id"), crowd=4).collect()
    for r in matched:
        near = [(q, metres((r.lat, r.lng), q[2:])) for q in large]
        first = [q[0] for q, d in near if q[1] == r.name and d < 100]
        second = [q[0] for q, d in near if d < 50 and (q[1] in r.name or r.name in q[1] or len(set(q[1].split()) & set(r.name.split())) >= 2)]
        assert (r.match_id, r.match_step) == (((first or second)[0], 1 if first else 2) if first or second else (None, None))


def test_word_masks_lose_no_pair(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(90)]  # more words than bits
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12)))) for i in range(150)]
    df = spark.createDataFrame(rows, "i int, n string").withColumn("m", rc.word_mask(F.col("n"))).persist()
    both = df.crossJoin(df.selectExpr("i as j", "n as n2", "m as m2")).select(
        rc.may_share_two(F.col("m"), F.col("m2")).alias("may"), (rc.shared_words(F.col("n"), F.col("n2")) >= 2).alias("do")
    )
    counts = {(r.may, r.do): r["count"] for r in both.groupBy("may", "do").count().collect()}
    assert counts[True, True] and counts[False, False] and (False, True) not in counts
    assert 0 < df.filter("m < 0").count() < 150
