"""Readers: declared schemas, whole tables, rules about bad rows kept in the plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.text import key_name


def read_places(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Place records as JSON lines, or as one JSON array per file with ``multi_line``."""
    raw = spark.read.schema(S.PLACE_JSON).json(path, multiLine=multi_line)
    # JSON keys are text; the days of the closing times are numbers
    return raw.withColumn("closing_times", F.transform_keys("closing_times", lambda k, _: k.cast("int")))


def read_place_payloads(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(S.PLACE_PAYLOAD).json(path, multiLine=multi_line)


def read_osm_elements(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(S.OSM_ELEMENT).json(path, multiLine=multi_line)


def read_review_bundles(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(S.REVIEW_BUNDLE).json(path, multiLine=multi_line)


def read_first_available(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet", **options) -> DataFrame:
    """The first of several tables that exists."""
    for i, path in enumerate(paths):
        try:
            return spark.read.format(fmt).options(**options).load(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND" or i == len(paths) - 1:
                raise
    raise ValueError("no paths given")


def parse_register(rows: DataFrame, postcodes: Sequence[str], value: Column | None = None) -> DataFrame:
    """Certification register from ';' separated lines.

    Rows with fewer than six fields are dropped, outer quotes removed and only the
    given postcodes kept.
    """
    line = F.col("value") if value is None else value
    parts = F.split(line, ";", -1)
    clean = F.transform(parts, lambda p: F.regexp_replace(p, r'^"+|"+$', ""))
    out = rows.select(clean.alias("f"), *[c for c in rows.columns if c != "value"]).filter(F.size("f") >= 6)
    fields = [F.coalesce(F.get("f", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(S.REGISTER_FIELDS)]
    keep = [c for c in out.columns if c != "f"]
    return out.select(*keep, *fields).filter(F.col("postcode").isin(list(postcodes)))


def read_register(spark: SparkSession, path: str, postcodes: Sequence[str]) -> DataFrame:
    """Register files with a header row; quoted fields may hold the separator."""
    names = S.REGISTER_FIELDS
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.csv(
        path, schema=schema, sep=";", header=True, mode="PERMISSIVE", enforceSchema=True, encoding="UTF-8",
        escape='"',
    )
    # a row with fewer than six fields leaves the sixth column null
    clean = [F.regexp_replace(F.coalesce(F.col(n), F.lit("")), r'^"+|"+$', "").alias(n) for n in names]
    # an empty sixth field is also read as null, so test the fields before it as well
    long_enough = F.col("municipality").isNotNull() | F.col("code").isNotNull() | F.col("valid_until").isNotNull()
    return raw.filter(long_enough).select(*clean).filter(F.col("postcode").isin(list(postcodes)))


def valid_candidates(rows: DataFrame) -> DataFrame:
    """Hand-filled candidates: rating 1 to 5 and at least five reviews, everything castable."""
    typed = rows.withColumns(
        {
            "rating": F.col("rating").try_cast("double"),
            "review_count": F.col("review_count").try_cast("bigint"),
            "lat": F.col("lat").try_cast("double"),
            "lng": F.col("lng").try_cast("double"),
        }
    )
    return typed.filter(
        F.col("rating").between(1, 5)
        & (F.col("review_count") >= 5)
        & F.col("lat").isNotNull()
        & F.col("lng").isNotNull()
    )


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return valid_candidates(spark.read.csv(path, header=True))


def mention_lookup(mentions: DataFrame, order: str) -> DataFrame:
    """key, mentions: lower-cased stripped name, the last row of a name wins."""
    return mentions.groupBy(key_name(F.col("name")).alias("key")).agg(
        F.max_by("reddit_mentions", order).alias("mentions")
    )


def read_mentions(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The filtered list if it exists, else the raw one; file order decides between equal names."""
    raw = read_first_available(spark, paths, "json", multiLine=True)
    rows = raw.select("name", F.col("reddit_mentions").cast("bigint").alias("reddit_mentions")).withColumn(
        "_row", F.monotonically_increasing_id()
    )
    return mention_lookup(rows, "_row")
