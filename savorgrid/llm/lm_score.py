"""Language-model scoring by Katz backoff (operator 9)."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from savorgrid.session import materialise, new_folder

from .textcore import LOWER, PrefixHash, chunks, mix, word_spans

END = np.uint64(0x5851F42D4C957F2D)  # the end of a text, also the history of its first word
CUT = 5  # counts above this are not discounted
BLOCK_BYTES = 6 << 20
STATS = [f"n{r}" for r in range(1, CUT + 2)]
MESSAGE = "bucket int, block long, keys binary, counts binary, extra binary"
REPLY = f"block long, bucket int, reply binary, types long, tokens long, {', '.join(f'{s} long' for s in STATS)}"


@dataclass
class Discounts:
    """Good-Turing discount factors by count (1 above CUT) and the totals they come from."""

    types: int
    tokens: int
    factor: np.ndarray
    seen: float  # sum of the discounted counts

    @classmethod
    def of(cls, types: int, tokens: int, n: list[int]) -> Discounts:
        """Katz's discounts from the counts of counts; where those are too thin for a factor between 0 and 1,
        half an occurrence is taken off. The backoff weights are exact for any factors."""
        factor = np.ones(CUT + 2)
        for r in range(1, CUT + 1):
            d = -1.0
            if n[0] and n[r - 1]:
                tail = (CUT + 1) * n[CUT] / n[0]
                if tail != 1:
                    d = ((r + 1) * n[r] / n[r - 1] / r - tail) / (1 - tail)
            factor[r] = d if 0 < d < 1 else 1 - 0.5 / r
        return cls(types, tokens, factor, tokens - sum(r * n[r - 1] * (1 - factor[r]) for r in range(1, CUT + 1)))

    def discounted(self, counts: np.ndarray) -> np.ndarray:
        return counts * self.factor[np.minimum(counts, CUT + 1)]


class Unigrams:
    """P(word): discounted shares of the known words; what they leave goes to the one unknown type."""

    def __init__(self, d: Discounts):
        self.d = d
        left = 1 - d.seen / d.tokens if d.tokens else 1.0
        self.flat = left <= 1e-12  # no count is discounted: one more token makes room
        self.unknown = 1 / (d.tokens + 1) if self.flat else left

    def of(self, counts: np.ndarray) -> np.ndarray:
        known = counts / (self.d.tokens + 1) if self.flat else self.d.discounted(counts) / max(1, self.d.tokens)
        return np.where(counts > 0, known, self.unknown)


def _squeeze(counts: np.ndarray) -> bytes:
    """Counts are small numbers for the most part."""
    return zlib.compress(counts.astype(np.int64).tobytes(), 1)


def _counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), np.int64)


def _blocks(width: int, kinds: list[pa.DataType], names: list[str]):
    """Runs of texts as one row each: the other columns, and the words as numbers into a sorted word list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        for batch in batches:
            size = sum(len(b) for _, _, b, _ in chunks(batch.column(width)))
            budget = max(1, -(-size // max(1, -(-size // BLOCK_BYTES))))
            for first, last, buf, off in chunks(batch.column(width), budget):
                buf = LOWER[buf]
                starts, ends, word_at = word_spans(buf, off)
                hashes = [np.zeros(0, np.uint64)]
                for k in range(0, len(starts), 500_000):
                    s, e = starts[k : k + 500_000], ends[k : k + 500_000]
                    hashes.append(PrefixHash(buf[s[0] : e[-1]]).spans(s - s[0], e - s[0]))
                hashes = np.insert(np.concatenate(hashes), word_at[1:], END)
                words, tokens = np.unique(hashes, return_inverse=True)
                bounds = word_at + np.arange(len(word_at))
                own = pa.StructArray.from_arrays([c.slice(first, last - first).cast(k) for c, k in zip(batch.columns[:width], kinds, strict=True)], names=names)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), own),
                        pa.array([words.tobytes()], pa.binary()), pa.array([tokens.astype(np.uint32).tobytes()], pa.binary()),
                        pa.array([bounds.astype(np.int64).tobytes()], pa.binary()),
                        pa.array([np.array(batch.column(width + 1).slice(first, last - first), dtype=bool).tobytes()], pa.binary()),
                    ],
                    names=["block", "rows", "words", "tokens", "bounds", "trained"],
                )
                block += 1

    return run


class Block:
    """The words of one block and what the other rounds have found out about them."""

    def __init__(self, words: bytes, tokens: bytes, bounds: bytes, trained: bytes):
        self.words = np.frombuffer(words, np.uint64)
        self.tokens = np.frombuffer(tokens, np.uint32).astype(np.int64)
        self.bounds = np.frombuffer(bounds, np.int64)
        self.trained = np.repeat(np.frombuffer(trained, bool), np.diff(self.bounds))  # of each token

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different (history, word) pairs in hash order: hashes, histories, words; each token's pair; trained counts."""
        history = np.empty_like(self.tokens)
        history[1:] = self.tokens[:-1]
        history[self.bounds[:-1]] = np.searchsorted(self.words, END)
        n = len(self.words)
        keys, of_token = np.unique(history * n + self.tokens, return_inverse=True)
        h, w = keys // n, keys % n
        hashes = mix(self.words[h] * np.uint64(0x9E3779B97F4A7C15) + self.words[w])
        order = np.argsort(hashes, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        of_token = place[of_token]
        counts = np.bincount(of_token[self.trained], minlength=len(order))
        return hashes[order], h[order], w[order], of_token, counts


def _messages(block: int, buckets: int, keys: np.ndarray, counts: np.ndarray, extra: np.ndarray | None = None) -> pa.RecordBatch:
    """A block's sorted keys, cut into ranges of the key space."""
    edges = np.concatenate([[0], np.searchsorted(keys, _edges(buckets)), [len(keys)]])
    cut = [(i, a, b) for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if b > a]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, _, _ in cut], pa.int32()), pa.array([block] * len(cut), pa.int64()),
            pa.array([keys[a:b].tobytes() for _, a, b in cut], pa.binary()), pa.array([_squeeze(counts[a:b]) for _, a, b in cut], pa.binary()),
            pa.array([None if extra is None else extra[a:b].tobytes() for _, a, b in cut], pa.binary()),
        ],
        names=["bucket", "block", "keys", "counts", "extra"],
    )


def _edges(buckets: int) -> np.ndarray:
    return np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64)


def _reducer(fold):
    """Answers every message of a range of keys; ``fold`` takes key numbers, and the messages' arrays."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(k, np.uint64) for k in group["keys"]]
        at = np.cumsum([len(k) for k in keys])[:-1]
        _, number = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([_counts(c) for c in group["counts"]])
        extra = np.concatenate([np.frombuffer(x, np.float64).reshape(-1, 2) for x in group["extra"]]) if group["extra"].notna().all() else None
        reply, summary = fold(number, counts, extra)
        bucket = int(group["bucket"].iloc[0])
        out = pd.DataFrame({"block": group["block"], "bucket": bucket, "reply": [_squeeze(r) if r.dtype == np.int64 else r.tobytes() for r in np.split(reply, at)]})
        for name in ("types", "tokens", *STATS):
            out[name] = 0
            out.loc[out.index[:1], name] = summary.get(name, 0)
        return out

    return run


def _count(number: np.ndarray, counts: np.ndarray, extra: np.ndarray | None) -> tuple[np.ndarray, dict[str, int]]:
    """Each key's count in all, doubled, plus 1 in the first message that has trained on it."""
    total = np.zeros(number.max() + 1, dtype=np.int64)
    np.add.at(total, number, counts)
    has = np.flatnonzero(counts)
    _, first = np.unique(number[has], return_index=True)
    reply = total[number] * 2
    reply[has[first]] += 1
    n = np.bincount(np.minimum(total, CUT + 2), minlength=CUT + 3)
    return reply, {"types": int((total > 0).sum()), "tokens": int(total.sum()), **{s: int(n[r + 1]) for r, s in enumerate(STATS)}}


def _weigh(number: np.ndarray, counts: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, dict[str, int]]:
    """Backoff weights: (1 - discounted shares of the seen words) / (1 - their unigram shares), negative for
    a history none of whose counts is discounted, which counts one more token instead."""
    sums = np.zeros((number.max() + 1, 2))
    np.add.at(sums, number, extra)
    count = np.zeros(len(sums), dtype=np.int64)
    np.maximum.at(count, number, counts)
    seen = np.maximum(count, 1)
    left = 1 - sums[:, 0] / seen
    full = (count > 0) & (left <= 1e-9)
    left = np.where(full, 1 / (seen + 1), left)
    weight = np.where(count > 0, left / np.maximum(1 - sums[:, 1], 1e-12), 1.0)
    return np.where(full, -weight, weight)[number], {}


class KatzScorer:
    """Bigram Katz model of a table's trained rows, and the score of all its rows.

    Texts are encoded once in blocks, written in buckets by block, so that no later round moves them. A
    round sends what the blocks ask about (different words, different pairs, different histories), cut by
    ranges of hashes; each range counts over the whole corpus and answers every block that asked. Frequent
    words are one entry for each block, so no key is crowded. The n-gram counts are tables partitioned by
    range, nothing of them is broadcast or reaches the driver but their counts of counts.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _ask(self, messages: DataFrame, fold) -> DataFrame:
        return materialise(messages.groupBy("bucket").applyInPandas(_reducer(fold), REPLY))

    def _with(self, table: str, *replies: DataFrame) -> DataFrame:
        out = self.spark.table(table)
        for i, r in enumerate(replies):
            own = r.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "reply"))), lambda x: x["reply"]).alias(f"reply{i}"))
            out = out.join(own, "block")
        return out

    def score(self, docs: DataFrame, trained: Column, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
        """The rows with n_tokens, n_known, train_tokens, base_score (add-one unigram) and score (log10).

        A null or empty text is one end token. Without trained rows every word is unknown and both scores
        are 0. Repeated rows count and are scored each; a null condition counts as not trained; clashing
        columns are replaced. ``carry``: columns to bring along, all but the text by default.
        """
        added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
        carry = [c for c in (docs.columns if carry is None else carry) if c not in (text_col, *added)]
        names = [f"c_{i}" for i in range(len(carry))] or ["c_0"]
        own = [F.col(c).alias(n) for c, n in zip(carry, names, strict=False)] or [F.lit(0).alias("c_0")]
        picked = docs.select(*own, F.col(text_col).alias("__text"), F.coalesce(trained, F.lit(False)).alias("__trained"))
        fields = [StructField(n, picked.schema[n].dataType) for n in names]
        kinds = [to_arrow_type(f.dataType) for f in fields]
        schema = StructType([
            StructField("block", LongType()), StructField("rows", ArrayType(StructType(fields))),
            *[StructField(n, BinaryType()) for n in ("words", "tokens", "bounds", "trained")],
        ])
        table, path, buckets = f"lm_{uuid.uuid4().hex}", new_folder(self.spark), self.buckets
        blocks = picked.mapInArrow(_blocks(len(names), kinds, names), schema)
        blocks.repartition(buckets, "block").write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, "block").saveAsTable(table)

        def load(batch: pa.RecordBatch, i: int) -> Block:
            return Block(*[batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("words", "tokens", "bounds", "trained")])

        def answer(batch: pa.RecordBatch, name: str, i: int, read=_counts) -> np.ndarray:
            return np.concatenate([read(x) for x in batch.column(batch.schema.get_field_index(name))[i].as_py()])

        def floats(blob: bytes) -> np.ndarray:
            return np.frombuffer(blob, np.float64)

        def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    b = load(batch, i)
                    counts = np.bincount(b.tokens[b.trained], minlength=len(b.words))
                    yield _messages(batch.column(0)[i].as_py(), buckets, b.words, counts)

        def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    hashes, _, _, _, counts = load(batch, i).pairs()
                    yield _messages(batch.column(0)[i].as_py(), buckets, hashes, counts)

        stored = ["block", "words", "tokens", "bounds", "trained"]
        word_counts = self._ask(self.spark.table(table).select(stored).mapInArrow(ask_words, MESSAGE), _count)
        words = self._discounts(word_counts)
        pair_counts = self._ask(self.spark.table(table).select(stored).mapInArrow(ask_pairs, MESSAGE), _count)
        pairs = self._discounts(pair_counts)
        unigrams = Unigrams(words)

        def ask_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    b = load(batch, i)
                    count, pair = answer(batch, "reply0", i) >> 1, answer(batch, "reply1", i)
                    _, h, w, _, _ = b.pairs()
                    mine = (pair & 1) > 0  # each pair is summed in one block
                    sums = np.stack([
                        np.bincount(h[mine], pairs.discounted(pair[mine] >> 1), len(b.words)),
                        np.bincount(h[mine], unigrams.of(count[w[mine]]), len(b.words)),
                    ], axis=1)
                    yield _messages(batch.column(0)[i].as_py(), buckets, b.words, count, sums)

        weights = self._ask(self._with(table, word_counts, pair_counts).select(*stored, "reply0", "reply1").mapInArrow(ask_weights, MESSAGE), _weigh)
        added_fields = [StructField("n_tokens", LongType()), StructField("n_known", LongType()), StructField("train_tokens", LongType()), StructField("base_score", DoubleType()), StructField("score", DoubleType())]

        def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    b = load(batch, i)
                    count = answer(batch, "reply0", i) >> 1
                    pair = answer(batch, "reply1", i) >> 1
                    weight = answer(batch, "reply2", i, floats)
                    _, h, w, of_token, _ = b.pairs()
                    # P(w | h): the discounted share if the pair was seen, else the weight times P(w)
                    full = weight[h] < 0
                    share = np.where(full, pair, pairs.discounted(pair)) / np.maximum(count[h] + full, 1)
                    p = np.where(pair > 0, share, np.abs(weight[h]) * unigrams.of(count[w]))
                    base = np.log10((count + 1) / (words.tokens + words.types + 1))
                    starts = b.bounds[:-1]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *batch.column(1)[i].values.flatten(), pa.array(np.diff(b.bounds)), pa.array(np.add.reduceat((count > 0)[b.tokens].astype(np.int64), starts)),
                            pa.array(np.full(len(starts), words.tokens, dtype=np.int64)),
                            pa.array(np.add.reduceat(base[b.tokens], starts)), pa.array(np.add.reduceat(np.log10(p)[of_token], starts)),
                        ],
                        names=[*names, *added],
                    )

        ready = self._with(table, word_counts, pair_counts, weights).select("block", "rows", *stored[1:], "reply0", "reply1", "reply2")
        out = ready.mapInArrow(evaluate, StructType([*fields, *added_fields]))
        return out.select(*[F.col(n).alias(c) for n, c in zip(names, carry, strict=False)], *added)

    def _discounts(self, replies: DataFrame) -> Discounts:
        r = replies.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "tokens", *STATS)]).first()
        return Discounts.of(r["types"], r["tokens"], [r[s] for s in STATS])


def training(id_col: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) != fold
