"""Incremental review ingest: drop repeats, then keep the newest row per key in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merges import first_by
from ..operators.reviews import review_key

BUCKETS = 64


def start_review_ingest(reviews: DataFrame, sink: str, checkpoint: str, ts: str = "ts") -> StreamingQuery:
    """Append each review once to a table partitioned by key bucket.

    ``reviews`` is a stream of venue_id, reviewer_name, text, ... and an event time. Repeats
    within the watermark are dropped in state; a repeated batch overwrites its own folder.
    """
    keyed = reviews.withColumn("review_key", review_key()).withWatermark(ts, "1 day")
    fresh = keyed.dropDuplicatesWithinWatermark(["venue_id", "review_key"])

    def write(batch: DataFrame, epoch: int) -> None:
        bucket = F.pmod(F.xxhash64("venue_id", "review_key"), F.lit(BUCKETS))
        # a bucket is written by one task; every state partition holds rows of all of them
        dealt = batch.withColumn("bucket", bucket).repartition(BUCKETS, "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{sink}/epoch={epoch:012d}")

    return (
        fresh.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def current_reviews(spark: SparkSession, sink: str, ts: str = "ts") -> DataFrame:
    """The newest version of every (venue, review key)."""
    rows = spark.read.option("basePath", sink).parquet(f"{sink}/epoch=*")
    newest = first_by(rows.withColumn("_age", -F.unix_micros(ts)), ["venue_id", "review_key"], "_age")
    return newest.drop("_age", "bucket", "epoch")
