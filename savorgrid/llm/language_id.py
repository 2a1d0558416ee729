"""Language ID by multinomial naive Bayes over hashed character n-grams (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .textcore import LOWER, PrefixHash, chunks, freeing

UNKNOWN = "und"


def _grams(column: pa.Array, orders: tuple[int, ...], bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Sparse rows of a batch: (first row, last + 1, n-gram buckets, where each row's buckets start).

    A bucket is listed as often as it occurs, so a row's product with a weight column is a plain sum.
    """
    shift = np.uint64(64 - bits)
    for first, last, buf, off in chunks(column, 1 << 20):
        hashes = PrefixHash(LOWER[buf])
        chars = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))  # where characters start
        char_at = np.searchsorted(chars, off)
        for n in orders:
            starts = np.arange(max(0, len(chars) - n))
            # n-grams that stay in their text
            text = np.searchsorted(char_at, starts, "right") - 1
            starts = starts[starts + n <= char_at[text + 1]]
            ids = (hashes.spans(chars[starts], chars[starts + n]) >> shift).astype(np.int32)
            yield first, last, ids, np.searchsorted(starts, char_at)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def sample_bounded(docs: DataFrame, group: str, key: Column, per_group: int) -> DataFrame:
    """About ``per_group`` rows of each group at most, picked by a hash of ``key``, never in order of size."""
    counts = {r[0]: r[1] for r in docs.groupBy(group).count().collect()}  # a row for each language
    if all(n <= per_group for n in counts.values()):
        return docs
    share = F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, min(1.0, per_group / n))])
    return docs.where(F.pmod(F.xxhash64(key.cast("string")), F.lit(1 << 30)) < F.element_at(share, F.col(group)) * (1 << 30))


@dataclass
class LanguageModel:
    """Log-probabilities of n-gram buckets (languages x 2**bits) and of the languages."""

    languages: list[str]
    weights: np.ndarray
    prior: np.ndarray
    orders: tuple[int, ...]
    bits: int

    @classmethod
    def fit(
        cls, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        orders: tuple[int, ...] = (1, 2, 3), bits: int = 16, smoothing: float = 0.5, docs_per_language: int = 20_000,
    ) -> LanguageModel:
        """Learn from the rows with a language and a text.

        ``docs_per_language`` bounds the sample that is counted; the model has languages x 2**bits cells,
        however large the table. Without any labelled row every prediction is ``und``.
        """
        rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
        rows = rows.where("lang is not null and text is not null and text <> ''")
        rows = sample_bounded(rows, "lang", F.col("id"), docs_per_language)

        @freeing
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells: dict[str, np.ndarray] = {}
            for batch in batches:
                langs = batch.column(0).to_pylist()
                for first, last, ids, at in _grams(batch.column(1), orders, bits):
                    for i in range(last - first):
                        lang = langs[first + i]
                        if lang not in cells:
                            cells[lang] = np.zeros(1 << bits, dtype=np.int64)
                        found, n = np.unique(ids[at[i] : at[i + 1]], return_counts=True)
                        cells[lang][found] += n
            for lang, v in cells.items():
                at = np.flatnonzero(v)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(v[at])], names=["lang", "cell", "n"])

        cells = rows.select("lang", "text").mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
        per_lang = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
        languages = sorted(per_lang)
        weights = np.zeros((len(languages), 1 << bits), dtype=np.float32)
        for i, lang in enumerate(languages):
            own = cells[cells.lang == lang]
            n = np.full(1 << bits, smoothing)
            n[own.cell.to_numpy()] += own.n.to_numpy()
            weights[i] = np.log(n / n.sum())
        total = max(1, sum(per_lang.values()))
        prior = np.log(np.array([per_lang[x] / total for x in languages], dtype=np.float64))
        return cls(languages, weights, prior, tuple(orders), bits)

    def predict(self, docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
        """The rows with lang_pred and score, the posterior probability of that language.

        A null text and a text without any letter get ``und`` with score 0, as does every text of a model
        without languages. Ties go to the language first in order. Repeated rows are scored each; columns
        called like the added ones are replaced; ``carry``: columns to bring along, all by default.
        """
        added = ["lang_pred", "score"]
        carry = [c for c in (docs.columns if carry is None else carry) if c not in added]
        own = [] if text_col in carry else [F.col(text_col).alias("__text")]
        letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__letter")
        picked = docs.select(*carry, *own, letter)
        width, letter_at = len(carry), len(carry) + len(own)
        text_at = width if own else carry.index(text_col)
        model = docs.sparkSession.sparkContext.broadcast((self.languages, self.weights, self.prior))
        orders, bits = self.orders, self.bits

        @freeing
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            languages, weights, prior = model.value
            names = np.array([*languages, UNKNOWN], dtype=object)
            for batch in batches:
                scores = np.tile(prior, (batch.num_rows, 1))
                for first, last, ids, at in _grams(batch.column(text_at), orders, bits):
                    for k in range(len(languages)):
                        scores[first:last, k] += _sums(weights[k].take(ids), at)
                known = batch.column(letter_at).to_numpy(zero_copy_only=False).astype(bool) & bool(languages)
                best = np.full(batch.num_rows, len(languages))
                score = np.zeros(batch.num_rows)
                if languages:
                    top = scores.argmax(axis=1)
                    share = 1.0 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
                    best, score = np.where(known, top, best), np.where(known, share, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:width], pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=[*carry, *added]
                )

        schema = StructType([*docs.select(*carry).schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
        return picked.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold
