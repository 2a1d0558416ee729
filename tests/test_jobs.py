"""Ranking, merging, scoring, models and streams on small fixtures."""

import math
import os
import re
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from bindings.tables import PACK, Tables
from savorgrid.context import CityPack, demo_pack
from savorgrid.functions.geo import RadiusCells
from savorgrid.operators import merges as mg
from savorgrid.operators import names as nm
from savorgrid.operators import ranking as rk
from savorgrid.operators import reviews as rv
from savorgrid.plans import model as md
from savorgrid.plans import score as sc
from savorgrid.sources import readers as rd
from savorgrid.sources import writers as wr
from savorgrid.streaming import reviews as st
from savorgrid.streaming import traffic as tr

SF = "/root/testdata/sf0.001"


def test_value_ranks_with_a_hot_value(spark):
    vals = [4.0] * 300 + [i / 97 for i in range(600)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, score double")
    got = {r._v: r.r for r in rk.value_ranks(df, "score", "r", ranges=8).collect()}
    want = pd.Series(vals).rank(method="min", ascending=False)
    assert all(got[v] == want[i] for i, v in enumerate(vals))
    empty = rk.value_ranks(df.filter("id < 0"), "score", "r")
    assert empty.count() == 0


def test_contiguous_folds(spark):
    df = spark.range(103).withColumnRenamed("id", "id").repartition(4)
    folds = [r.fold for r in md.contiguous_folds(df, 5).orderBy("id").collect()]
    assert folds == [0] * 21 + [1] * 21 + [2] * 21 + [3] * 20 + [4] * 20


def test_attempts_success_clears_failures(spark):
    log = [("a", 1, False, "x"), ("a", 2, True, None), ("a", 3, False, "y"), ("b", 1, False, "p"), ("b", 2, False, "q"), ("c", 1, True, None)]
    out = {r.key: r for r in mg.attempt_status(spark.createDataFrame(log, "key string, ts int, ok boolean, error string")).collect()}
    assert (out["a"].attempts, out["a"].status, out["a"].last_error) == (1, "completed", "y")
    assert (out["b"].attempts, out["b"].status, out["b"].first_failed_at, out["b"].last_error) == (2, "failed", 1, "q")
    assert (out["c"].attempts, out["c"].status) == (0, "completed")


def test_dedup_is_idempotent(spark):
    rows = [(1, "A", 1.00001, 2.0), (2, "a", 1.00002, 2.0), (3, "b", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "id int, name string, lat double, lng double")
    once = mg.first_by_place(df, "id")
    assert sorted(r.id for r in once.collect()) == [1, 3]
    assert sorted(r.id for r in mg.first_by_place(once, "id").collect()) == [1, 3]


def test_score_properties(spark):
    v = Tables(spark, SF).venues().withColumns(
        {
            "price_numeric": F.expr("cast(id % 5 as int)"),
            "review_count": F.expr("case when id % 7 = 0 then null else review_count end"),
            "residual": F.expr("case when id % 5 = 0 then double('NaN') else residual end"),
        }
    )
    rows = sc.score_venues(v, PACK).select("id", "score", "components", "tier", "review_count").collect()
    for r in rows:
        total = sum(r.components)
        assert 0 <= r.score <= 1 and not math.isnan(r.score)
        assert r.score == pytest.approx(min(1.0, max(0.0, total)))
        want = "Gold" if r.score >= 0.55 else "Silver" if r.score >= 0.48 else "Bronze" if r.score >= 0.30 else "Unranked"
        assert r.tier == want
        assert r.review_count is not None


def test_languages_reach_the_score(spark):
    v = Tables(spark, SF).venues().withColumn("price_numeric", F.lit(3)).withColumn("lat", F.lit(PACK.office_hub[0])).withColumn("lng", F.lit(PACK.office_hub[1]))
    plain = sc.score_venues(v, PACK).select("components.office_penalty").first()[0]
    english = v.withColumn("review_languages", F.expr("map('en', 9L, 'fr', 1L)"))
    spoken = sc.score_venues(english, PACK).select("components.office_penalty").first()[0]
    assert plain == pytest.approx(-0.03 * (0.4 * 0.5 + 0.3))
    assert spoken == pytest.approx(-0.03 * (0.4 * 0.5 + 0.3 * 0.5 + 0.3))


def test_guides_equal_a_search_of_each_phrase(spark):
    pack = replace(demo_pack(), star_names={"le coin": 2, "coin": 1}, star_exact={"x": 3}, bib_names=["bon bec"], guide_names=["'t huis"], guide_exact=["y"])
    names = ["Le Coin", "Au Coin d'Or", "Coing", "X", "Bon Bec-2", "Bonbec", "Chez 't Huis", "Y", "", None, "Coin, Bon Bec"]
    df = spark.createDataFrame([(None if i % 3 else 7, i, n) for i, n in enumerate(names)], "id int, i int, name string")

    def holds(name, phrase):
        return re.search(r"(^|[^a-z])" + re.escape(phrase) + r"($|[^a-z])", name) is not None

    for r in nm.with_guides(df, pack).collect():
        low = (names[r.i] or "").lower()
        star = pack.star_exact.get(low) or next((v for p, v in pack.star_names.items() if holds(low, p)), 0)
        assert r.michelin_stars == star, low
        assert r.bib_gourmand == any(holds(low, p) for p in pack.bib_names), low
        assert r.gault_millau == (any(holds(low, p) for p in pack.guide_names) or low in pack.guide_exact), low


def test_every_row_has_a_position(spark):
    df = spark.range(0, 3000).selectExpr("id", "case when id % 11 = 0 then null else id % 5 end as rating")
    got = {r.id: r.pos for r in rk.with_positions(df, "rating").collect()}
    order = sorted(range(3000), key=lambda i: (i % 11 == 0, -(i % 5) if i % 11 else 0, i))
    assert got == {i: n for n, i in enumerate(order, 1)}


def test_reviews_that_open_alike_both_stay(spark):
    head = "The same opening words, more than fifty characters long, "
    rows = [(i, 1, "r", head + str(i % 60)) for i in range(120)]
    df = spark.createDataFrame(rows, "review_id int, venue_id int, reviewer_name string, text string")
    assert {r.review_id for r in rv.distinct_reviews(df, "review_id").collect()} == set(range(60))
    assert rv.distinct_reviews(df, "review_id", prefix=50).count() == 1
    assert rv.distinct_reviews(df, "review_id", per_venue=5).count() == 5


def test_radius_cells_meet_all_around_the_globe(spark):
    cells = RadiusCells(5000.0)
    near = [((0.0, 179.999), (0.0, -179.999)), ((10.0, -180.0), (10.01, 179.99)), ((88.99, 5.0), (89.005, 5.2)),
            ((89.98, 0.0), (89.99, 180.0)), ((-89.99, 20.0), (-89.985, -170.0)), ((50.0, 4.0), (50.03, 4.03))]
    df = spark.createDataFrame([(i, *a, *b) for i, (a, b) in enumerate(near)], "i int, alat double, alng double, blat double, blng double")
    a, b = [F.col("alat"), F.col("alng")], [F.col("blat"), F.col("blng")]
    out = df.select(F.array_contains(cells.around(*a), cells.home(*b)).alias("ab"), F.array_contains(cells.around(*b), cells.home(*a)).alias("ba"))
    assert all(r.ab and r.ba for r in out.collect())


def test_pack_round_trip(tmp_path):
    pack = demo_pack()
    pack.save(str(tmp_path / "p.json"))
    assert CityPack.load(str(tmp_path / "p.json")) == pack
    (tmp_path / "q.json").write_text('{"city": "Other"}')
    assert CityPack.load(str(tmp_path / "q.json"), pack).districts == pack.districts
    with pytest.raises(ValueError):
        CityPack.from_dict({"city": "x", "nonsense": 1})


def test_register_file(spark, tmp_path):
    lines = [
        "id;name;street;nr;postcode;town;code;until",
        '"1";"A; B";"Rue";"1";"1000";"T";"S";"2027"',
        "2;Short;Rue;1;1000",
        "3;C;Rue;1;1000;T",
        "4;D;Rue;1;9999;T;S;2027",
    ]
    (tmp_path / "r.csv").write_text("\n".join(lines))
    got = rd.read_register(spark, str(tmp_path / "r.csv"), ["1000"]).orderBy("id").collect()
    assert [(r.id, r.name) for r in got] == [("1", "A; B"), ("3", "C")]


def test_mentions_fall_back_and_last_wins(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"name": "Foo ", "reddit_mentions": 1}, {"name": "foo", "reddit_mentions": 4}]')
    got = rd.read_mentions(spark, [str(tmp_path / "none.json"), str(tmp_path / "m.json")]).collect()
    assert [(r.key, r.mentions) for r in got] == [("foo", 4)]


def test_worklist_columns(spark, tmp_path):
    df = spark.createDataFrame([(0, "A B", "Rue 1", 1.0, 2.0, "Thai")], "priority int, name string, address string, lat double, lng double, cuisine string")
    work = wr.candidate_worklist(df)
    assert work.columns == wr.WORKLIST_COLUMNS
    assert work.first().google_maps_link.endswith("/A+B+Rue+1")
    wr.write_csv(work, str(tmp_path / "w"))
    assert spark.read.csv(str(tmp_path / "w"), header=True).count() == 1


def test_clusters_and_model(spark):
    from bindings.q_rules import featured
    from bindings.tables import HEX
    from savorgrid.operators.cells import hex_table

    f = featured(Tables(spark, "/root/testdata/sf0.01")).persist()
    settings = md.TreeSettings(iterations=5, depth=4)
    fitted = md.predict(md.train(f, settings), f)
    spread = fitted.agg(F.stddev("residual"), F.stddev("rating")).first()
    assert spread[0] < spread[1]
    logit = md.predict(md.train(f, settings, logit=True), f, logit=True).agg(F.min("predicted_rating"), F.max("predicted_rating")).first()
    assert 1.0 <= logit[0] and logit[1] <= 5.0
    hexes = md.with_geometry(md.cluster_cells(hex_table(f), seeds=2), HEX)
    labels = {r.cluster_label: r.m for r in hexes.groupBy("cluster_label").agg(F.avg("mean_rating").alias("m")).collect()}
    assert list(sorted(labels, key=labels.get, reverse=True)) == ["Elite", "Strong", "Everyday", "Emerging"]
    assert hexes.stat.corr("hub_score", "mean_rating") >= -0.5
    f.unpersist()


def test_daily_views_stream_equals_batch(spark, tmp_path):
    src, sink, ckpt = (str(tmp_path / n) for n in ("src", "sink", "ckpt"))
    events = spark.range(500).selectExpr("timestamp_seconds(1704067200 + id * 3600) as ts", "id")
    events.filter("id < 300").coalesce(1).write.parquet(f"{src}/a")
    schema = events.schema

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{src}/*")
        tr.start_daily_views(stream, sink, ckpt).awaitTermination()
        return {(r.day, r.views) for r in tr.read_daily(spark, sink).collect()}

    first = run()
    assert first == {(r.day, r.views) for r in tr.daily_views(events.filter("id < 300")).collect()}
    events.filter("id >= 300").coalesce(1).write.parquet(f"{src}/b")
    assert run() == {(r.day, r.views) for r in tr.daily_views(events).collect()}
    assert run() == {(r.day, r.views) for r in tr.daily_views(events).collect()}


def test_view_series_fills_gaps(spark):
    daily = spark.sql("select date'2024-03-01' as day, 5L as views union all select date'2024-03-09', 2L")
    rows = {str(r.day): r for r in tr.view_series(daily).collect()}
    assert len(rows) == 30
    assert (rows["2024-03-07"].last_7, rows["2024-03-08"].last_7, rows["2024-03-09"].last_30) == (5, 0, 7)
    stats = tr.traffic_stats(daily).first()
    assert (stats.total, stats.today, stats.last_7_days, stats.last_30_days) == (7, 2, 2, 7)


def test_training_partitions_grow_with_rows_then_with_cores():
    assert [md.training_partitions(n, 12) for n in (0, 1, 20_001, 100_000, 1_200_000, 7_200_000, 30_000_000)] == [1, 1, 2, 5, 12, 12, 36]


@pytest.mark.parametrize("as_folder", [False, True])
def test_stream_queries_read_a_file_or_a_folder(spark, tmp_path, as_folder):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).toPandas()
    if as_folder:
        (tmp_path / "documents.parquet").mkdir()
        docs[:30].to_parquet(tmp_path / "documents.parquet/part-0.parquet")
        docs[30:].to_parquet(tmp_path / "documents.parquet/part-1.parquet")
    else:
        docs.to_parquet(tmp_path / "documents.parquet")
    got = entry.queries()["t03_review_stream"](spark, str(tmp_path)).collect()
    assert len(got) == len(set(got)) == len({(n % 97, s, t) for n, s, t in zip(docs.n_chars, docs.source, docs.text)})


def test_review_stream_drops_repeats(spark, tmp_path):
    src, sink, ckpt = (str(tmp_path / n) for n in ("src", "sink", "ckpt"))
    rows = [(1, "ann", "good " * 20 + str(i % 2), f"2024-01-01 00:0{i}:00") for i in range(4)] + [(2, "bob", "x", "2024-01-01 00:05:00")]
    df = spark.createDataFrame(rows, "venue_id int, reviewer_name string, text string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.write.parquet(src)
    st.start_review_ingest(spark.readStream.schema(df.schema).parquet(src), sink, ckpt).awaitTermination()
    got = st.current_reviews(spark, sink).collect()
    assert sorted((r.venue_id, r.reviewer_name) for r in got) == [(1, "ann"), (1, "ann"), (2, "bob")]  # texts that only open alike both stay
    assert os.path.isdir(sink)


@pytest.mark.parametrize("name", ["m02_expected_by_trees", "m03_cross_validation", "m06_save_and_load"])
def test_registered_trees_are_as_many_and_as_deep_as_the_default(spark, name, monkeypatch):
    import __spark_entry__ as entry

    used = []

    def trees(settings, label):
        used.append(settings)
        raise InterruptedError

    monkeypatch.setattr(md, "_trees", trees)
    with pytest.raises(InterruptedError):
        entry.queries()[name](spark, SF)
    assert [(s.iterations, s.depth) for s in used] == [(200, 8)]


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_folds_of_any_ids(spark, kind):
    ids = [f"ChIJ{i}" for i in range(23)] if kind == "string" else [2**53 + i for i in range(23)]
    df = spark.createDataFrame([(i,) for i in ids], f"id {kind}")
    got = {r.id: r.fold for r in md.contiguous_folds(df, 5).collect()}
    want = [k for k, n in enumerate((5, 5, 5, 4, 4)) for _ in range(n)]
    assert got == dict(zip(sorted(ids), want, strict=True))


def test_cross_validation_in_threads(spark):
    df = spark.createDataFrame(
        [(f"p{i}", f"c{i % 3}", "v", *[float((i * k) % 7) for k in range(1, 8)], 3.0 + (i % 3) / 2) for i in range(60)],
        "id string, category string, venue_type string, " + ", ".join(f"{c} double" for c in md.NUMERIC) + ", rating double",
    )
    rows = md.cross_validate(df, md.TreeSettings(iterations=3, depth=2, min_leaf=1), folds=3).collect()
    assert [r.fold for r in rows] == [0, 1, 2] and all(r.r2 > 0.4 for r in rows)


def _random_features(spark, n):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 7))
    y = 4 + 0.3 * x[:, 0] + 0.2 * np.sin(3 * x[:, 1]) + 0.1 * rng.normal(size=n)
    rows = [
        (f"p{i:04}", "rare" if i in (3, 5) else None if i % 50 == 0 else f"c{rng.integers(4)}", f"v{rng.integers(3)}", *x[i].tolist(), float(y[i]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "id string, category string, venue_type string, " + ", ".join(f"{c} double" for c in md.NUMERIC) + ", rating double")


@pytest.mark.parametrize("logit", [False, True])
def test_trees_of_all_folds_are_those_of_single_fits(spark, logit):
    df = _random_features(spark, 600)  # fold 0 has a level that its fit has not seen
    settings = md.TreeSettings(iterations=5, depth=4, min_leaf=5)
    got = {r.fold: r.r2 for r in md.cross_validate(df, settings, 3, logit).collect()}
    placed = md.contiguous_folds(df, 3).persist()
    for k in range(3):
        model = md.train(placed.filter(F.col("fold") != k), settings, logit)
        held = md.predict(model, placed.filter(F.col("fold") == k), logit).select("rating", "predicted_rating").toPandas()
        want = 1 - ((held.rating - held.predicted_rating) ** 2).sum() / ((held.rating - held.rating.mean()) ** 2).sum()
        assert got[k] == pytest.approx(want, abs=1e-6)
    placed.unpersist()


def test_more_folds_take_no_more_passes(spark):
    df = _random_features(spark, 120).persist()
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for folds in (2, 5):
        group = f"passes-of-{folds}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            md.cross_validate(df, md.TreeSettings(iterations=4, depth=3, min_leaf=5), folds).collect()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(tracker.getJobIdsForGroup(group)))
    assert jobs[1] <= jobs[0] + 2 * 3  # the figures of three more folds


def test_trees_do_not_depend_on_partitions(spark, monkeypatch):
    df = _random_features(spark, 300).persist()
    settings, got = md.TreeSettings(iterations=22, depth=3, min_leaf=5), []  # so many that the state is written once
    for parts, block, direct in ((1, 1 << 17, 16), (5, 16, 16), (5, 16, 2)):
        monkeypatch.setattr(md, "training_partitions", lambda rows, cores, parts=parts: parts)
        monkeypatch.setattr(md.boosting, "BLOCK", block)
        monkeypatch.setattr(md.boosting, "DIRECT", direct)
        got.append([r.r2 for r in md.cross_validate(df, settings, 3).collect()])
    assert got[1] == pytest.approx(got[0], abs=1e-12) and got[2] == pytest.approx(got[0], abs=1e-12)
