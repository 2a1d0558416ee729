"""The corpus pipeline: five stages over ``documents``, from raw rows to packed sequences.

Each stage works on all rows its predecessor kept. Run as a whole, a stage's result is written to the
shared folder and read again, so a lost executor costs no more than a stage.

Defined results, for every stage: an empty table gives an empty one; columns beside ``doc_id``, ``text`` and
``lang`` are carried along whatever they are called, and may be missing; repeated ids and null ids are
rows like any other. The first stage drops null texts, which the later ones take as empty ones.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from savorgrid.llm.exact_dedup import DigestIndex  # noqa: E402
from savorgrid.llm.language_id import UNKNOWN, LanguageModel  # noqa: E402
from savorgrid.llm.near_dedup import keep_one_similar  # noqa: E402
from savorgrid.llm.packing import pack  # noqa: E402
from savorgrid.llm.queries import tokenizer_file  # noqa: E402
from savorgrid.llm.suffix_dedup import remove_repeats  # noqa: E402
from savorgrid.session import materialise, ship_package  # noqa: E402

#: A document whose best language has a lower posterior than this is in none of them.
MIN_SCORE = 0.5

#: Documents that a Python worker is sent at once. Ten thousand, the default, are tens of MB of text in each copy.
BATCH_ROWS = "2000"


def _prepare(spark: SparkSession) -> None:
    """Ships the package; batches of whole texts are kept small, unless the submitter chose their size."""
    ship_package(spark)
    if "spark.sql.execution.arrow.maxRecordsPerBatch" not in dict(spark.sparkContext.getConf().getAll()):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def _named_apart(docs: DataFrame, used: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage(docs)`` with the columns that it does not use numbered, so that none is taken for one of its own."""
    names = [c if c in used else f"column_{i}" for i, c in enumerate(docs.columns)]
    return stage(docs.toDF(*names)).select(names).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language: null, empty, without letters, or undecided between languages.

    Without any labelled row no language is known, and every document goes. Repeated rows are judged alike.
    """
    _prepare(spark)

    def known(rows: DataFrame) -> DataFrame:
        found = LanguageModel.fit(rows).predict(rows)
        return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE))

    return _named_apart(docs, ("doc_id", "text", "lang"), known)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text, white space apart: the smallest doc_id, null ids last; of rows that share it, one.

    Null counts as empty.
    """
    index = DigestIndex(spark, id_type=docs.schema["doc_id"].dataType.simpleString())
    return _named_apart(docs, ("doc_id", "text"), index.keep_new)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component: five-word shingles, Jaccard similarity 0.8 or more.

    Close SimHash fingerprints propose links, which the shingles confirm; 64 bits cannot tell all such pairs, so
    the others are found by the shingles.
    The smallest doc_id stays, null ids last; texts without words are equal, a shorter text is one shingle.
    """
    _prepare(spark)
    return _named_apart(docs, ("doc_id", "text"), lambda rows: keep_one_similar(rows, width=5, similarity=0.8))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts, of 400 bytes or of over 50 words; every document stays, if need be empty.

    A text with copies goes entirely, if it is that long; a null text stays null. ``n_chars``, where there is one,
    is counted again.
    """
    _prepare(spark)
    out = _named_apart(docs, ("text",), lambda rows: remove_repeats(rows, width=400, words=51))
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row for each piece; an empty text is one token, null counts as empty."""
    _prepare(spark)
    return pack(docs, tokenizer_file("word_bpe_49k.json"), capacity=2048, carry=["doc_id"])


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

#: Fingerprints, suffix sorting and tokenisers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
