"""Sinks: every task writes its own part, nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.address import search_link

MAP_SEARCH = "https://www.google.com/maps/search/"

WORKLIST_COLUMNS = [
    "priority", "name", "address", "lat", "lng", "cuisine", "google_maps_link", "rating", "review_count", "added",
]
MANUAL_COLUMNS = [
    "osm_id", "name", "address", "lat", "lng", "cuisine",
    "google_rating", "google_review_count", "google_place_id", "notes",
]


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that a row fits a CSV file."""
    cols = []
    for f in df.schema.fields:
        nested = f.dataType.typeName() in ("array", "map", "struct")
        cols.append(F.to_json(f.name).alias(f.name) if nested else F.col(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def candidate_worklist(candidates: DataFrame) -> DataFrame:
    """Candidates with a search link and empty cells to fill in by hand."""
    empty = F.lit(None).cast("string")
    return candidates.withColumns(
        {
            "google_maps_link": search_link(MAP_SEARCH, F.col("name"), F.col("address")),
            "rating": empty,
            "review_count": empty,
            "added": empty,
        }
    ).select(*WORKLIST_COLUMNS)


def manual_worklist(venues: DataFrame) -> DataFrame:
    blank = {c: F.lit(None).cast("string") for c in MANUAL_COLUMNS[6:]}
    return venues.withColumns(blank).select(*MANUAL_COLUMNS)
