"""Page views per day: as a stream with a table of day counts, and the figures read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEEP_DAYS = 90


def daily_views(events: DataFrame, ts: str = "ts") -> DataFrame:
    """day, views; works on a batch and on a stream (late rows beyond a day are dropped there)."""
    if events.isStreaming:
        events = events.withWatermark(ts, "1 day")
        by_window = events.groupBy(F.window(ts, "1 day")).agg(F.count(F.lit(1)).alias("views"))
        return by_window.select(F.to_date("window.start").alias("day"), "views")
    return events.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("views"))


def keep_newest(daily: DataFrame, days: int = KEEP_DAYS) -> DataFrame:
    """The newest day buckets; at most ``days`` rows leave the sort."""
    return daily.orderBy(F.desc("day")).limit(days)


def start_daily_views(events: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Run the counter over what is there and stop; the sink holds (day, views, epoch) versions.

    Every micro-batch appends the new state of the days it touched; ``read_daily`` takes the
    newest version of a day, so a repeated batch changes nothing.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(
            f"{sink}/epoch={epoch:012d}"
        )

    return (
        daily_views(events)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def read_daily(spark: SparkSession, sink: str) -> DataFrame:
    rows = spark.read.schema("day date, views bigint, epoch bigint").parquet(f"{sink}/epoch=*")
    return rows.groupBy("day").agg(F.max_by("views", "epoch").alias("views"))


def view_series(daily: DataFrame, today: Column | None = None, days: int = 30) -> DataFrame:
    """Dense series of the last days with zeros, and the 7 and 30 day sums up to each day.

    The spine is generated from the newest day (or ``today``), so it has ``days`` rows.
    """
    last = daily.agg((F.max("day") if today is None else F.max(today)).alias("last"))
    reach = days + 29  # earlier days feed the sums of the first ones shown
    spine = last.select(
        "last", F.explode(F.sequence(F.date_sub("last", reach - 1), F.col("last"))).alias("day")
    )
    filled = spine.join(daily, "day", "left").withColumn("views", F.coalesce("views", F.lit(0)))
    by_day = W.orderBy(F.datediff("day", F.lit("1970-01-01").cast("date")))  # days + 29 rows
    return (
        filled.withColumns(
            {
                "last_7": F.sum("views").over(by_day.rangeBetween(-6, 0)),
                "last_30": F.sum("views").over(by_day.rangeBetween(-29, 0)),
            }
        )
        .filter(F.col("day") > F.date_sub("last", days))
        .drop("last")
    )


def traffic_stats(daily: DataFrame, today: Column | None = None) -> DataFrame:
    """One row: total, today, last 7 and last 30 days."""
    last = daily.agg((F.max("day") if today is None else F.max(today)).alias("last"))
    age = F.datediff("last", "day")
    one = F.lit(1).alias("_one")
    return (
        daily.select("*", one)
        .join(last.select("*", one), "_one")
        .agg(
            F.sum("views").alias("total"),
            F.coalesce(F.sum(F.when(age == 0, F.col("views"))), F.lit(0)).alias("today"),
            F.coalesce(F.sum(F.when(age.between(0, 6), F.col("views"))), F.lit(0)).alias("last_7_days"),
            F.coalesce(F.sum(F.when(age.between(0, 29), F.col("views"))), F.lit(0)).alias("last_30_days"),
        )
    )
