"""Aggregates per hexagon and their way back to the venues.

Cells are aggregated first and joined back. A window per cell would pull a crowded cell
into one task; the aggregate is folded map-side and the join can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_counts(df: DataFrame) -> DataFrame:
    """Venues and mean rating per cell; rows without a cell do not count."""
    return (
        df.filter(F.col("cell").isNotNull())
        .groupBy("cell")
        .agg(F.count(F.lit(1)).alias("hex_restaurant_count"), F.avg("rating").alias("hex_mean_rating"))
    )


def entropy_of(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """-sum p ln(p + 1e-10) over the rows of each key, p = share of ``n``."""
    totals = counts.groupBy(*keys).agg(F.sum(n).alias("_total"))
    p = F.col(n) / F.col("_total")
    return (
        counts.join(totals, keys)
        .groupBy(*keys)
        .agg((-F.sum(p * F.log(p + F.lit(1e-10)))).alias("entropy"))
    )


def category_entropy(df: DataFrame) -> DataFrame:
    counts = (
        df.filter(F.col("cell").isNotNull() & F.col("category").isNotNull())
        .groupBy("cell", "category")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return entropy_of(counts, ["cell"]).withColumnRenamed("entropy", "hex_cuisine_entropy")


def chain_share(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("cell").isNotNull())
        .groupBy("cell")
        .agg(F.avg(F.col("is_chain").cast("int")).alias("hex_chain_share"))
    )


def cell_features(df: DataFrame) -> DataFrame:
    """Count, mean rating, category entropy and chain share per cell from one grouping.

    Grouping by (cell, category) first gives partial sums for everything, entropy included.
    """
    by_category = (
        df.filter(F.col("cell").isNotNull())
        .groupBy("cell", "category")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("rating").alias("rating_sum"),
            F.count("rating").alias("rating_n"),
            F.sum(F.col("is_chain").cast("int")).alias("chains"),
            F.count("is_chain").alias("chain_n"),
        )
    )
    # sum of -p ln(p + eps) needs the cell total; few categories per cell, so collect their counts
    cells = by_category.groupBy("cell").agg(
        F.sum("n").alias("hex_restaurant_count"),
        (F.sum("rating_sum") / F.nullif(F.sum("rating_n"), F.lit(0))).alias("hex_mean_rating"),
        (F.sum("chains") / F.nullif(F.sum("chain_n"), F.lit(0))).alias("hex_chain_share"),
        F.sum(F.when(F.col("category").isNotNull(), F.col("n"))).alias("_total"),
        F.collect_list(F.when(F.col("category").isNotNull(), F.col("n"))).alias("_counts"),
    )

    def term(acc: Column, n: Column) -> Column:
        p = n / F.col("_total").cast("double")
        return acc - p * F.log(p + F.lit(1e-10))

    entropy = F.aggregate("_counts", F.lit(0.0), term)
    return cells.withColumn("hex_cuisine_entropy", entropy).drop("_total", "_counts")


def add_cell_features(df: DataFrame) -> DataFrame:
    """Every venue with the aggregates of its cell; null cells get null."""
    keep = [c for c in df.columns if not c.startswith("hex_")]
    return df.select(*keep).join(cell_features(df), "cell", "left")


def hex_table(df: DataFrame) -> DataFrame:
    """One row per cell with its ratings, residuals, volume, chains, prices and categories.

    The distinct categories come from the (cell, category) partial sums, so there is a single
    shuffle of pre-aggregated rows and no expansion for the distinct count.
    """
    means = ["rating", "residual", "review_count", "price_numeric"]
    partial = (
        df.filter(F.col("cell").isNotNull())
        .groupBy("cell", "category")
        .agg(
            *[F.sum(c).alias(f"s_{c}") for c in means],
            *[F.count(c).alias(f"n_{c}") for c in means],
            F.sum(F.col("is_chain").cast("int")).alias("chains"),
            F.count("is_chain").alias("chain_n"),
            F.count("name").alias("names"),
        )
    )

    def mean(c: str) -> Column:
        return F.sum(f"s_{c}") / F.nullif(F.sum(f"n_{c}"), F.lit(0))

    return partial.groupBy("cell").agg(
        mean("rating").alias("mean_rating"),
        mean("residual").alias("mean_residual"),
        F.coalesce(F.sum("s_review_count"), F.lit(0)).alias("total_reviews"),
        mean("review_count").alias("mean_reviews"),
        (F.sum("chains") / F.nullif(F.sum("chain_n"), F.lit(0))).alias("chain_share"),
        mean("price_numeric").alias("mean_price"),
        F.count("category").alias("cuisine_diversity"),
        F.sum("names").alias("restaurant_count"),
    )


CLUSTER_LABELS = ["Elite", "Strong", "Everyday", "Emerging"]


def cluster_stats(hexes: DataFrame) -> DataFrame:
    return hexes.groupBy("cluster").agg(
        F.avg("mean_rating").alias("mean_rating"),
        F.avg("mean_residual").alias("mean_residual"),
        F.avg("restaurant_count").alias("restaurant_count"),
    )


def label_clusters(hexes: DataFrame) -> DataFrame:
    """Clusters named by falling mean rating; the statistics are one row per cluster."""
    ranked = cluster_stats(hexes).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("mean_rating")).alias("r"), "cluster"))).alias("order")
    )
    named = ranked.select(F.posexplode("order").alias("pos", "c")).select(
        F.col("c.cluster").alias("cluster"),
        F.get(F.array(*[F.lit(x) for x in CLUSTER_LABELS]), F.col("pos")).alias("cluster_label"),
    )
    return hexes.join(named, "cluster", "left")
