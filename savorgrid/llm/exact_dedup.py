"""Exact dedup against a persistent digest index (operator 7)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from savorgrid.session import materialise, new_folder

SPACES = r"[\x20\x09-\x0D]+"
ADDED = ["keep_id", "group_size", "kept", "text_sha256"]


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with every run of white space replaced by one space; null counts as empty."""
    return F.sha2(F.encode(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), "UTF-8"), 256)


class DigestIndex:
    """A table of all digests seen so far, bucketed and sorted by digest.

    ``add`` reduces a delivery to one row per digest (map-side first, so that a text which makes up a
    third of the rows is one row per task before the shuffle), finds the digests that are new by a
    sort-merge anti-join which does not shuffle the index, and appends those. Only digests move. The number
    of buckets is written beside the folder: an index that is opened again takes it from there, and asking
    for another number is an error.

    Defined results: a null text counts as empty. Of equal texts the row with the smallest doc_id stays
    (null ids come last); rows that also share the doc_id are told apart by their place, and one of them
    stays. If an earlier delivery had the text, that delivery's row stays and no new one does. An empty
    delivery gives an empty result. Input columns called like the added ones are replaced.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, id_type: str = "bigint"):
        self.spark = spark
        self.path = path or new_folder(spark)
        self.buckets = self._layout(buckets)
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest STRING, keep_id {id_type}, copies BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def _layout(self, buckets: int | None) -> int:
        """The number of buckets that the index has, or that a new one gets from now on."""
        layout = f"{self.path}.layout"
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(layout)
        if folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            known = int(self.spark.read.text(layout).first()[0])
            if buckets not in (None, known):
                raise ValueError(f"the index at {self.path} has {known} buckets, not {buckets}")
            return known
        buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.spark.range(1).select(F.lit(str(buckets))).write.text(layout)
        return buckets

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
        """The delivery's rows with keep_id, group_size (rows of this delivery with the text), kept and
        text_sha256. ``carry``: the columns to bring along, all by default."""
        carry = [c for c in (docs.columns if carry is None else carry) if c not in ADDED]
        own = [f"c_{i}" for i in range(len(carry))]
        rows = materialise(
            docs.select(*[F.col(c).alias(o) for c, o in zip(carry, own, strict=True)], F.col(id_col).alias("__id"), text_digest(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("__row"))
        )
        groups = self._register(rows)
        verdicts = groups.select(
            "digest",
            F.when(F.col("known"), F.col("known_id")).otherwise(F.col("first.id")).alias("keep_id"),
            F.when(F.col("known").isNull(), F.col("first.row")).alias("__stays"),
            F.col("n").alias("group_size"),
        )
        return rows.join(verdicts, "digest").select(
            *[F.col(o).alias(c) for c, o in zip(carry, own, strict=True)], "keep_id", "group_size", F.coalesce(F.col("__row") == F.col("__stays"), F.lit(False)).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )

    def keep_new(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The delivery's rows that stay, with their own columns. Only they and their like are shuffled with
        their texts, by digest and id, so that copies spread; no copy of the texts is written."""
        digest = text_digest(F.col(text_col))
        groups = self._register(materialise(docs.select(F.col(id_col).alias("__id"), digest.alias("digest"), F.monotonically_increasing_id().alias("__row"))))
        stay = groups.where("known is null").select(F.col("digest").alias("__d"), F.col("first.id").alias("__keep"))
        rows = docs.withColumn("__digest", digest)
        kept = rows.join(stay, (F.col("__digest") == F.col("__d")) & rows[id_col].eqNullSafe(F.col("__keep")), "left_semi")
        return _first_of(kept, ["__digest", id_col]).select(docs.columns)

    def _register(self, rows: DataFrame) -> DataFrame:
        """(digest, first, n, known, known_id) of a delivery's digests; the new ones go into the index."""
        first = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row")))
        groups = rows.groupBy("digest").agg(first.alias("first"), F.count("*").alias("n"))
        index = self.spark.table(self.table)
        groups = materialise(groups)
        fresh = groups.select("digest", F.col("first.id").alias("keep_id"), F.col("n").alias("copies")).join(index.hint("merge"), "digest", "left_anti")
        fresh = materialise(fresh)  # before the index grows
        known = index.select("digest", F.col("keep_id").alias("known_id"), F.lit(True).alias("known"))
        groups = materialise(groups.join(known.hint("merge"), "digest", "left"))
        (
            fresh.repartition(self.buckets, "digest")
            .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", self.path).saveAsTable(self.table)
        )
        return groups


def _first_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One of the rows that are equal in ``keys``, null being a value."""
    one = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    return rows.withColumn("__n", one).where("__n = 1").drop("__n")
