"""The driver's tables as inputs of the library, on the Spark side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from savorgrid.context import demo_pack
from savorgrid.functions.geo import HexGrid

from . import expressions as X

PACK = demo_pack()
HEX = HexGrid(50.8467, 4.3525)


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """The table as a stream of its files: one file of that name, or all in a folder of that name.

        A pattern may match either; a plain path would have to be a folder.
        """
        path = f"{self.sf_dir}/{name}.parque[t]"
        return self.spark.readStream.schema(self.raw(name).schema).parquet(path)

    def _venue_rows(self) -> DataFrame:
        part, line = self.raw("part"), self.raw("lineitem")
        volume = (
            line.groupBy("l_partkey")
            .agg(F.sum("l_quantity").alias("s"))
            .select(
                "l_partkey",
                F.expr("cast(floor(s * ((l_partkey % 11) * (l_partkey % 11) + 1) / 50) as bigint)").alias("q"),
            )
        )
        return part.join(volume, part.p_partkey == volume.l_partkey, "left")

    def venues(self) -> DataFrame:
        rows = self._venue_rows()
        cols = [F.expr(sql).alias(c) for c, sql in X.VENUE.items()]
        hours = F.when(
            F.expr("p_partkey % 8 <> 7"), F.array(*[F.expr(X.hours_text(d)) for d in range(7)])
        ).alias("opening_hours")
        periods = self._periods().alias("periods")
        out = rows.select(*cols, hours, periods)
        return out.withColumn("types", F.split("types_csv", ","))

    def _periods(self) -> Column:
        """Up to two periods a day as array<struct<open, close>>."""

        def moment(day: str, hour: str, minute: str) -> Column:
            return F.struct(
                F.expr(f"cast({day} as int)").alias("day"),
                F.expr(f"cast({hour} as int)").alias("hour"),
                F.expr(f"cast({minute} as int)").alias("minute"),
            )

        out = []
        for day in range(7):  # 0 = Sunday here, 6 in the text lists
            opened = F.expr(X.is_open(str((day + 6) % 7)))
            close_day = f"({day} + (case when {X.MAIN_CLOSE} >= 24 then 1 else 0 end)) % 7"
            main = F.struct(
                moment(str(day), X.MAIN_OPEN, "0").alias("open"),
                moment(close_day, f"({X.MAIN_CLOSE}) % 24", "0").alias("close"),
            )
            second = F.struct(
                moment(str(day), X.SECOND_OPEN, "0").alias("open"),
                moment(str(day), X.SECOND_CLOSE, X.SECOND_MINUTE).alias("close"),
            )
            out += [F.when(opened, main), F.when(opened & F.expr(X.HAS_SECOND), second)]
        return F.array_compact(F.array(*out))

    def places(self) -> DataFrame:
        """Venues with the flat hours fields."""
        from savorgrid.functions.hours import closing_times, open_days

        return self.venues().withColumns(
            {"closing_times": closing_times(F.col("periods")), "days_open": open_days(F.col("periods"))}
        )

    def payloads(self) -> DataFrame:
        """Venues wrapped as nested place payloads; some fields are missing."""
        v = self.venues()
        return v.select(
            F.col("id").cast("string").alias("id"),
            F.struct(F.col("name").alias("text")).alias("displayName"),
            F.col("address").alias("formattedAddress"),
            F.struct(F.col("lat").alias("latitude"), F.col("lng").alias("longitude")).alias("location"),
            "rating",
            F.expr("nullif(review_count, 0)").alias("userRatingCount"),
            F.col("price_level").alias("priceLevel"),
            F.expr("case when id % 7 = 3 then null else types end").alias("types"),
            F.col("primary_type").alias("primaryType"),
            F.expr("case when id % 2 = 0 then named_struct('text', primary_type) end").alias(
                "primaryTypeDisplayName"
            ),
            F.lit(None).cast("string").alias("websiteUri"),
            F.concat(F.lit("https://maps.example/"), F.col("id").cast("string")).alias("googleMapsUri"),
            F.struct(F.col("opening_hours").alias("weekdayDescriptions"), "periods").alias(
                "regularOpeningHours"
            ),
        )

    def external(self) -> DataFrame:
        """One external record per venue."""
        return self.venues().select(*[F.expr(sql).alias(c) for c, sql in X.EXTERNAL.items()], "id")

    def osm_elements(self) -> DataFrame:
        e = self.external()
        tags = F.map_from_entries(
            F.filter(
                F.array(
                    *[
                        F.struct(F.lit(k).alias("k"), F.col(c).alias("v"))
                        for k, c in [
                            ("name", "name"), ("cuisine", "cuisine_tag"), ("amenity", "amenity"),
                            ("addr:street", "street"), ("addr:housenumber", "house"),
                            ("addr:postcode", "postcode"), ("outdoor_seating", "outdoor"),
                            ("wheelchair", "wheelchair"), ("diet:vegan", "vegan"),
                            ("diet:vegetarian", "vegetarian"), ("diet:halal", "halal"),
                        ]
                    ]
                ),
                lambda s: s["v"].isNotNull(),
            )
        )
        return e.select(
            F.col("ext_id").alias("id"),
            F.expr("case when is_way then 'way' else 'node' end").alias("type"),
            F.expr("case when not is_way then lat end").alias("lat"),
            F.expr("case when not is_way then lng end").alias("lon"),
            F.expr("case when is_way and id % 8 <> 0 then named_struct('lat', lat, 'lon', lng) end").alias("center"),
            tags.alias("tags"),
        )

    def _by_supplier(self, spec: dict[str, str]) -> DataFrame:
        s, v = self.raw("supplier"), self.venues()
        return s.join(v, s.s_suppkey == v.id).select(*[F.expr(sql).alias(c) for c, sql in spec.items()])

    def price_list(self) -> DataFrame:
        return self._by_supplier(X.PRICE_LIST)

    def register(self) -> DataFrame:
        return self._by_supplier(X.REGISTER)

    def doc_reviews(self) -> DataFrame:
        return self.raw("documents").select(*[F.expr(sql).alias(c) for c, sql in X.REVIEW_DOC.items()])

    def line_reviews(self) -> DataFrame:
        return self.raw("lineitem").select(*[F.expr(sql).alias(c) for c, sql in X.REVIEW_LINE.items()])
