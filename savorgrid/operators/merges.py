"""Deduplication, merging of snapshots, upserts and work-lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: Sequence[Column | str], order: str, keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of each key. Surplus rows are dropped before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return df.withColumn("_rn", rank).filter(F.col("_rn") <= keep).drop("_rn")


def first_seen(df: DataFrame, order: str, key: str = "id") -> DataFrame:
    return first_by(df.filter(F.col(key).isNotNull()), [key], order)


def first_by_place(df: DataFrame, order: str) -> DataFrame:
    """One row per lower-cased name and coordinates rounded to four places."""
    return first_by(df, [F.lower("name"), F.bround("lat", 4), F.bround("lng", 4)], order)


def merge_new(existing: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """All existing rows and those new ones whose key is not there; ``is_new`` tells them apart."""
    fresh = new.join(existing.select(key), key, "left_anti")
    fresh = first_by(fresh, [key], order) if order else fresh.dropDuplicates([key])
    return existing.withColumn("is_new", F.lit(False)).unionByName(
        fresh.withColumn("is_new", F.lit(True)), allowMissingColumns=True
    )


def upsert(existing: DataFrame, changes: DataFrame, key: str, ts: str) -> DataFrame:
    """The newest version of each key."""
    rows = existing.unionByName(changes, allowMissingColumns=True)
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.col(ts).desc()))
    return rows.withColumn("_rn", rank).filter(F.col("_rn") == 1).drop("_rn")


def refresh_hours(venues: DataFrame, fetched: DataFrame) -> DataFrame:
    """Put fetched hours on venues that have none; all others stay as they are.

    ``fetched``: id, opening_hours, closing_times, days_open.
    """
    fields = ["opening_hours", "closing_times", "days_open"]
    new = fetched.select("id", F.struct(*fields).alias("_new"))
    lacking = F.coalesce(F.size("closing_times"), F.lit(0)) <= 0
    take = lacking & F.col("_new").isNotNull()
    return (
        venues.join(new, "id", "left")
        .withColumn("_take", take)
        .withColumns({f: F.when(F.col("_take"), F.col(f"_new.{f}")).otherwise(F.col(f)) for f in fields})
        .withColumn("hours_updated", F.col("_take"))
        .drop("_new", "_take")
    )


def attempt_status(log: DataFrame) -> DataFrame:
    """Fold an attempt log (key, ts, ok, error) to one status per key.

    A success clears earlier failures; the failures after the last success count, with their
    first and last time and the last error. A key that ever succeeded is completed.
    """
    last_ok = log.groupBy("key").agg(F.max(F.when(F.col("ok"), F.col("ts"))).alias("_ok_at"))
    failed = ~F.col("ok") & (F.col("_ok_at").isNull() | (F.col("ts") > F.col("_ok_at")))
    return (
        log.join(last_ok, "key")
        .groupBy("key")
        .agg(
            F.max(F.col("_ok_at").isNotNull()).alias("completed"),
            F.count_if(failed).alias("attempts"),
            F.min(F.when(failed, F.col("ts"))).alias("first_failed_at"),
            F.max(F.when(failed, F.col("ts"))).alias("last_failed_at"),
            F.max_by(F.when(failed, F.col("error")), F.when(failed, F.col("ts"))).alias("last_error"),
        )
        .withColumn(
            "status",
            F.when(F.col("completed"), "completed").otherwise("failed"),
        )
    )


def completed_bundles(bundles: DataFrame) -> DataFrame:
    """Names of review bundles that hold reviews and no error."""
    ok = (F.coalesce(F.size("reviews"), F.lit(0)) > 0) & (F.coalesce("error", F.lit("")) == "")
    return bundles.filter(ok).select("name").distinct()


def pending(
    wanted: DataFrame, completed: DataFrame, failed: DataFrame, key: str = "name",
    retry_failed: bool = False, limit: int | None = None,
) -> DataFrame:
    """Wanted rows that are neither completed nor, unless retried, failed; the cap applies to
    the wanted list, in id order."""
    todo = wanted.orderBy("id").limit(limit) if limit else wanted
    todo = todo.join(completed.select(key), key, "left_anti")
    return todo if retry_failed else todo.join(failed.select(key), key, "left_anti")
