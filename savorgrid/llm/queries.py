"""The registered queries of this subpackage and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from savorgrid.session import ship_package

from . import sql
from .exact_dedup import DigestIndex
from .language_id import LanguageModel, held_out
from .licenses import scan_licenses
from .lm_score import KatzScorer, training
from .packing import pack
from .phrases import collocations
from .quality import quality_rules
from .sentencepiece_codec import decode, encode
from .shards import shard_by_bytes
from .simhash import near_duplicates
from .source_audit import source_audit
from .suffix_dedup import repeated_spans
from .vector_search import nearest_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op1_quality_rules": sql.QUALITY, "op7_exact_dedup": sql.EXACT_DEDUP, "op11_phrases": sql.PHRASES, "op13_source_audit": sql.SOURCE_AUDIT,
}


def query(fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    QUERIES[fn.__name__] = run
    return fn


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_quality_rules(docs: DataFrame) -> DataFrame:
    return quality_rules(docs, carry=["doc_id"])


@query
def op2_histogram_shards(docs: DataFrame) -> DataFrame:
    return shard_by_bytes(docs, shards=40).select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op3_license_scan(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs, carry=["doc_id"])


@query
def op4_sentencepiece(docs: DataFrame) -> DataFrame:
    model = tokenizer_file("piece_bpe_32k.model")
    coded = decode(encode(docs, model, carry=["doc_id", "text"]), model)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
        F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"),
    )


@query
def op5_best_fit_packing(docs: DataFrame) -> DataFrame:
    packed = pack(docs, tokenizer_file("word_bpe_49k.json"), capacity=2048, carry=["doc_id"])
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op6_simhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, width=4, radius=4, carry=["doc_id"])


@query
def op7_exact_dedup(docs: DataFrame) -> DataFrame:
    index = DigestIndex(docs.sparkSession, id_type=docs.schema["doc_id"].dataType.simpleString())
    return index.add(docs, carry=["doc_id"])


@query
def op8_language_id(docs: DataFrame) -> DataFrame:
    model = LanguageModel.fit(docs.where(~held_out()))
    return model.predict(docs.withColumn("held_out", held_out()), carry=["doc_id", "held_out"])


@query
def op9_lm_score(docs: DataFrame) -> DataFrame:
    docs = docs.withColumn("held_out", ~training())
    return KatzScorer(docs.sparkSession).score(docs, ~F.col("held_out"), carry=["doc_id", "held_out"])


@query
def op10_suffix_dedup(docs: DataFrame) -> DataFrame:
    return repeated_spans(docs, width=400, carry=["doc_id"], words=51).drop("spans", "passages")


@query
def op11_phrases(docs: DataFrame) -> DataFrame:
    return collocations(docs)


def op12_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return nearest_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


QUERIES[op12_nearest_vectors.__name__] = op12_nearest_vectors


@query
def op13_source_audit(docs: DataFrame) -> DataFrame:
    return source_audit(docs)
