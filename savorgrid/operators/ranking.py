"""Ranks, top lists and sort orders; every order ends with the id so that it is total."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import half_even
from ..session import materialise

RANK_BUCKETS = 256


def _desc(column: str) -> Column:
    return F.col(column).desc_nulls_last()


def top_n(df: DataFrame, by: str, limit: int = 50) -> DataFrame:
    """The ``limit`` best rows by one column."""
    return df.orderBy(_desc(by), "id").limit(limit)


def sort_venues(df: DataFrame, by: str) -> DataFrame:
    """Sorted by score, rating or residual; any other key leaves the order alone."""
    return df.orderBy(_desc(by), "id") if by in ("score", "rating", "residual") and by in df.columns else df


def positions(df: DataFrame, order: list[Column], out: str = "pos") -> DataFrame:
    """Every row with its place, from 1, in any total order of columns of any type.

    Rows are dealt by range, numbered within their range and moved up by the sizes of the ranges before;
    no task holds more than a range. The dealt rows are written once, as the ranges come from a sample.
    """
    dealt = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    # one row a range
    before = F.sum("_size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return (
        dealt.withColumn("_within", within).join(offsets, "_range")
        .withColumn(out, F.col("_before") + F.col("_within")).drop("_range", "_within", "_before")
    )


def with_positions(df: DataFrame, by: str, out: str = "pos") -> DataFrame:
    """Every row with its place, from 1, in the order of ``sort_venues``."""
    return positions(df, [_desc(by), F.col("id")], out)


def top_per_group(df: DataFrame, group: str, by: str) -> DataFrame:
    """The best row of each group; only one row per group and task is shuffled."""
    order = W.partitionBy(group).orderBy(_desc(by), "id")
    return df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") == 1).drop("_rn")


def subset_top(df: DataFrame, column: str, values: list[str], limit: int = 50) -> DataFrame:
    """Best rows of some categories, by score where there is one, else by rating."""
    by = "score" if "score" in df.columns else "rating"
    return df.filter(F.col(column).isin(values)).orderBy(_desc(by), "id").limit(limit)


def undervaluation(residual: Column) -> Column:
    return half_even(residual * 100, 1)


def gems(df: DataFrame, limit: int = 100) -> DataFrame:
    """Most undervalued venues with the residual as a percentage."""
    return top_n(df, "residual", limit).withColumn("undervaluation_pct", undervaluation(F.col("residual")))


def value_ranks(df: DataFrame, column: str, out: str, ranges: int = RANK_BUCKETS) -> DataFrame:
    """(value, rank) with rank 1 for the highest; equal values share the lowest rank.

    Counts per distinct value are cut into ranges of about equal size. The rank is the
    number of rows in higher ranges plus the number above within the range, so no task
    ever sees more than one range of distinct values.
    """
    value = F.col(column).cast("double")
    counts = materialise(
        df.filter(value.isNotNull() & ~F.isnan(value)).groupBy(value.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    )
    inner = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(counts.approxQuantile("_v", inner, 0.5 / ranges)))
    splits = [float("-inf"), *(cuts or [0.0]), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="_v", outputCol="_range").transform(counts)
    sizes = ranged.groupBy("_range").agg(F.sum("_n").alias("_size"))
    # at most ``ranges`` + 1 rows
    above = sizes.withColumn(
        "_above",
        F.coalesce(
            F.sum("_size").over(W.orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ),
    ).select("_range", "_above")
    within = F.coalesce(
        F.sum("_n").over(W.partitionBy("_range").orderBy(F.desc("_v")).rowsBetween(W.unboundedPreceding, -1)),
        F.lit(0),
    )
    return (
        ranged.withColumn("_within", within)
        .join(above, "_range")
        .select("_v", (F.col("_above") + F.col("_within") + 1).alias(out))
    )


def with_ranks(df: DataFrame) -> DataFrame:
    """Adds rating_rank, score_rank and how many places the score moves a venue up.

    The rows are read five times, so they are written once first; select what is needed before.
    """
    df = materialise(df)
    ratings, scores = value_ranks(df, "rating", "rating_rank"), value_ranks(df, "score", "score_rank")
    return (
        df.join(ratings.withColumnRenamed("_v", "rating"), "rating", "left")
        .join(scores.withColumnRenamed("_v", "score"), "score", "left")
        .withColumn("rank_improvement", F.col("rating_rank") - F.col("score_rank"))
    )


def winners(df: DataFrame, limit: int = 10) -> DataFrame:
    return with_ranks(df).orderBy(_desc("rank_improvement"), "id").limit(limit)
