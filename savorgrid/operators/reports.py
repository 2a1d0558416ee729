"""Grouped reports over venues, prices, labels and attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.address import street_label
from ..functions.numeric import half_even
from .filters import missing_ratings


def district_reviews(df: DataFrame) -> DataFrame:
    return df.groupBy("district").agg(F.sum("review_count").alias("total_reviews"))


def category_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("district", "category").agg(F.count(F.lit(1)).alias("n"))


def category_pivot(df: DataFrame, categories: list[str]) -> DataFrame:
    """One row per district, one column per category."""
    return df.groupBy("district").pivot("category", categories).agg(F.count(F.lit(1)))


def district_stats(df: DataFrame) -> DataFrame:
    """Mean rating, reviews, mean score and venues per district, rounded half-even to 2."""
    return (
        df.filter(F.col("district").isNotNull())
        .groupBy("district")
        .agg(
            half_even(F.avg("rating"), 2).alias("avg_rating"),
            F.sum("review_count").alias("total_reviews"),
            half_even(F.avg("score"), 2).alias("avg_score"),
            F.count("name").alias("restaurant_count"),
        )
    )


def histogram(df: DataFrame, column: str) -> DataFrame:
    """One row with map<value, count>, built from counts."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(column))


def run_summary(venues: DataFrame, hexes: DataFrame) -> DataFrame:
    """One row: size, means, spread of the residual, category and cluster histograms."""
    one = F.lit(1).alias("_one")
    totals = venues.agg(
        F.count(F.lit(1)).alias("total_restaurants"),
        F.avg("rating").alias("mean_rating"),
        F.avg("predicted_rating").alias("mean_predicted"),
        F.avg("residual").alias("mean_residual"),
        F.stddev_samp("residual").alias("std_residual"),
    )
    cells = hexes.agg(F.count(F.lit(1)).alias("num_hexagons"))
    cuisines = histogram(venues, "category").withColumnRenamed("category", "cuisines")
    clusters = histogram(hexes, "cluster_label").withColumnRenamed("cluster_label", "cluster_counts")
    out = totals.select("*", one)
    for part in (cells, cuisines, clusters):
        out = out.join(part.select("*", one), "_one")
    return out.drop("_one")


def price_stats(prices: DataFrame) -> DataFrame:
    """Entries, range, mean and number per band; missing and zero prices are left out of the figures."""
    p = F.nullif(F.col("average_price"), F.lit(0.0))
    return prices.agg(
        F.count(F.lit(1)).alias("entries"),
        F.min(p).alias("min_price"),
        F.max(p).alias("max_price"),
        F.avg(p).alias("mean_price"),
        F.count_if(p < 15).alias("cheap"),
        F.count_if((p >= 15) & (p < 30)).alias("mid_range"),
        F.count_if((p >= 30) & (p < 60)).alias("upscale"),
        F.count_if(p >= 60).alias("fine_dining"),
    )


def attribute_coverage(df: DataFrame) -> DataFrame:
    wheelchair = F.col("wheelchair").isNotNull() & (F.col("wheelchair") != "")
    return df.agg(
        F.count_if(F.col("outdoor_seating") == "yes").alias("outdoor_seating"),
        F.count_if(wheelchair).alias("wheelchair"),
        F.count_if(F.col("diet_vegan").isin("yes", "only")).alias("vegan"),
        F.count_if(F.col("diet_vegetarian").isin("yes", "only")).alias("vegetarian"),
    )


def streets_to_enrich(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Streets by number of venues that lack a rating, most first; all of them unless limited."""
    streets = (
        missing_ratings(df)
        .groupBy(street_label(F.col("address")).alias("street"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "street")
    )
    return streets if limit is None else streets.limit(limit)


def vocabulary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value): distinct values of several columns in one pass over the rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns]))
    return (
        df.select(pairs.alias("p")).select("p.field", "p.value").filter(F.col("value").isNotNull()).distinct()
        .orderBy("field", "value")
    )


def top_rated(df: DataFrame, limit: int = 10) -> DataFrame:
    """Best rated venues by rating, then reviews, with the mean over all rated ones."""
    rated = df.filter(F.col("rating") > 0)
    mean = rated.agg(F.avg("rating").alias("average_rating")).withColumn("_one", F.lit(1))
    top = rated.orderBy(F.desc("rating"), F.desc("review_count"), "id").limit(limit).withColumn("_one", F.lit(1))
    return top.join(mean, "_one").drop("_one")


def validation_report(labelled: DataFrame) -> DataFrame:
    """Verdict shares per group, age band and category in one pass.

    ``labelled``: grp, verdict, band, category, score. Rows: dimension, value, verdict, n,
    share of the dimension's value, mean score. A null verdict is the total of the value.
    """
    dims = F.explode(
        F.array(
            F.struct(F.lit("group").alias("dimension"), F.col("grp").alias("value")),
            F.struct(F.lit("band").alias("dimension"), F.col("band").alias("value")),
            F.struct(F.lit("category").alias("dimension"), F.col("category").alias("value")),
        )
    )
    per_verdict = (
        labelled.select(dims.alias("d"), "verdict", "score")
        .groupBy("d.dimension", "d.value", "verdict")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.count("score").alias("sn"))
    )
    mean = half_even(F.sum("s") / F.nullif(F.sum("sn"), F.lit(0)), 1).alias("mean_score")
    totals = per_verdict.groupBy("dimension", "value").agg(F.sum("n").alias("total"), mean)
    share = half_even(F.col("n") / F.col("total") * 100, 1).alias("share")
    detail = per_verdict.join(totals, ["dimension", "value"]).select(
        "dimension", "value", "verdict", "n", share, "mean_score"
    )
    whole = totals.select(
        "dimension", "value", F.lit(None).cast("string").alias("verdict"), F.col("total").alias("n"),
        F.lit(100.0).alias("share"), "mean_score",
    )
    return detail.unionByName(whole)


def false_negative_rate(labelled: DataFrame, control: str, missed: str) -> DataFrame:
    """Share of control rows that should have been picked."""
    rows = labelled.filter(F.col("grp") == control)
    rate = half_even(F.count_if(F.col("verdict") == missed) / F.nullif(F.count(F.lit(1)), F.lit(0)) * 100, 1)
    return rows.agg(F.count(F.lit(1)).alias("control_rows"), rate.alias("false_negative_pct"))
