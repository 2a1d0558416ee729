"""Approximate nearest neighbours by a permutation index (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from savorgrid.session import materialise

SAMPLE = 2048  # vectors from which the pivots are chosen
PIVOTS = 256  # pivots at most
NEAREST = 128  # nearest pivots by which a vector is posted and ranked
RERANKED = 10.0  # times the root of their number so many vectors, the first by footrule distance, have their products computed
BLOCK = 4096  # vectors of an index block, about
QUERY_BLOCK = 512  # queries that search a block at once


@dataclass(frozen=True)
class Pivots:
    """Sampled vectors and the largest norm of the table. Every vector is lengthened by one component that
    brings it to that norm, so that the nearest pivot is the one with the largest product."""

    vectors: np.ndarray
    norm: float

    def order(self, vectors: np.ndarray, queries: bool, nearest: int) -> np.ndarray:
        """Numbers of the ``nearest`` pivots of each vector, nearest first."""
        last = np.sqrt(np.maximum(self.norm**2 - (self.vectors**2).sum(axis=1), 0.0))
        products = vectors @ self.vectors.T
        if not queries:  # a query's own last component is zero, and its length does not change the order
            products += np.sqrt(np.maximum(self.norm**2 - (vectors**2).sum(axis=1), 0.0))[:, None] * last
        return np.argsort(-products, axis=1, kind="stable")[:, :nearest]


def far_apart(vectors: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the vectors, one after the other the one whose nearest chosen one is farthest away."""
    directions = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    chosen, nearest = [0], directions @ directions[0]
    while len(chosen) < min(count, len(vectors)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, directions @ directions[chosen[-1]])
    return vectors[chosen]


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _weights(order: np.ndarray, pivots: int) -> np.ndarray:
    """How far from the end of a vector's list each pivot stands, 0 if it is not in it."""
    out = np.zeros((len(order), pivots), dtype=np.int16)
    n = order.shape[1]
    out[np.arange(len(order))[:, None], order] = np.arange(n, 0, -1, dtype=np.int16)
    return out


class InvertedFile:
    """For each pivot the vectors that have it among their nearest, with the place it has there."""

    def __init__(self, order: np.ndarray, pivots: int):
        n, width = order.shape
        flat = order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.rows = by_pivot // max(width, 1)
        self.weights = (width - by_pivot % max(width, 1)).astype(np.int16)
        self.bounds = np.searchsorted(flat[by_pivot], np.arange(pivots + 1))
        self.n = n

    def closeness(self, queries: np.ndarray) -> np.ndarray:
        """For each vector and query what the footrule distance lacks to its maximum, halved.

        With lists of n pivots, a missing one counting as place n, the distance is n (n + 1) less twice the
        sum over common pivots of n - max(place, place); weights are n - place.
        """
        most = int(queries[:1].sum())  # every list is as long
        out = np.zeros((self.n, len(queries)), dtype=np.int16 if most < 1 << 15 else np.int32)
        for pivot in np.flatnonzero(queries.any(axis=0)):
            at = slice(self.bounds[pivot], self.bounds[pivot + 1])
            out[self.rows[at]] += np.minimum(self.weights[at][:, None], queries[:, pivot])
        return out


def _packed(key: str, size: int, pivots, nearest: int, queries: bool):
    """Vectors of one block, which come together, as one row: their keys, smallest ids, components, pivots."""

    def row(block: int, held: list[pa.RecordBatch]) -> dict:
        t = pa.Table.from_batches(held).combine_chunks()
        vectors = _matrix(t["v"].chunk(0))
        order = pivots.value.order(vectors, queries, nearest).astype(np.int16)
        names = np.stack([t[c].to_numpy() for c in ("k1", "k2", "id")], axis=1).astype(np.int64)
        narrow = vectors.astype(np.float32)
        exact = narrow if np.array_equal(narrow.astype(np.float64), vectors) else vectors
        return {key: block, "n": len(vectors), "names": names.tobytes(), "vectors": exact.tobytes(), "wide": exact.dtype == np.float64, "places": order.tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = [], None

        def out():
            return pa.RecordBatch.from_pylist([row(block, held)], schema=pa.schema([(key, pa.int32()), ("n", pa.int32()), ("names", pa.binary()), ("vectors", pa.binary()), ("wide", pa.bool_()), ("places", pa.binary())]))

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, [len(blocks)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == b:
                    continue
                if held and (blocks[a] != block or sum(h.num_rows for h in held) + b - a > size):
                    yield out()
                    held = []
                block = int(blocks[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield out()

    return run


PACKED = "{} int, n int, names binary, vectors binary, wide boolean, places binary"


def _search(pivots: int, keep: int, share: float):
    """For every query of a row the ``keep`` vectors of its index block with the largest products, of those
    that come first by footrule distance."""

    def unpack(r):
        names = np.frombuffer(r["names"], np.int64).reshape(-1, 3)
        vectors = np.frombuffer(r["vectors"], np.float64 if r["wide"] else np.float32).reshape(len(names), -1).astype(np.float64)
        return names, vectors, np.frombuffer(r["places"], np.int16).reshape(len(names), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index = None, None
        for batch in batches:
            for i, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if index is None or last != i["names"]:
                    last = i["names"]
                    names, vectors, places = unpack(i)
                    index = InvertedFile(places, pivots)
                q_names, q_vectors, q_places = unpack(q)
                close = index.closeness(_weights(q_places, pivots)).T
                n = min(len(names), max(keep, int(np.ceil(share * len(names)))))
                some = np.argpartition(-close, n - 1, axis=1)[:, :n] if n < len(names) else np.tile(np.arange(n), (len(q_names), 1))
                rows, who, scores = [], [], []
                for k in range(len(q_names)):
                    of = some[k]
                    products = np.einsum("ij,j->i", vectors[of], q_vectors[k])
                    best = np.lexsort((names[of, 2], -products))[:keep]
                    rows.append(of[best])
                    scores.append(products[best])
                    who.append(np.full(len(best), k))
                rows, who = np.concatenate(rows), np.concatenate(who)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(q_names[who, c]) for c in (0, 1)], *[pa.array(names[rows, c]) for c in (0, 1, 2)], pa.array(np.concatenate(scores) + 0.0)],
                    names=["q1", "q2", "k1", "k2", "id", "score"],
                )

    return run


def _usable(v: Column) -> Column:
    """Neither null, empty nor zero, and without null or non-finite components."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest_vectors(
    rows: DataFrame, query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    pivots: int = PIVOTS, nearest: int = NEAREST, reranked: float = RERANKED, block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that ``query`` selects the ``k`` others with the largest
    inner products found, nearest first, ties to the smaller id; all others if there are fewer.

    The pivots, chosen far apart from SAMPLE vectors picked by hash, are the only sample. Every vector is known by the order of its
    ``nearest`` pivots and posted under each of them with its place. The index lies in blocks of about
    ``block`` vectors, dealt by hash, each an inverted file of its own; the stated queries search every
    block in groups. In a block the vectors are ranked by the footrule distance of the two orders, and the
    first by their exact products, in double precision: ``reranked`` sqrt(N) of all N vectors, every block its
    part, and k + 1 at least.

    Equal vectors are one entry with its k + 1 smallest ids, and equal queries search once, so a vector that
    makes up a third of the table costs one. Vectors that are null, empty or zero or hold null or
    non-finite components, and rows without an id, take no part, nor do vectors of another length than most
    have (the longest among equals). Rows equal in id and vector count once; a row never finds its own id. An
    empty table gives no rows; other columns are not read.
    """
    spark = rows.sparkSession
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    clean = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("raw"), v.alias("v"), F.coalesce(query, F.lit(False)).alias("query"))
    clean = clean.where(F.col("id").isNotNull() & _usable(F.col("v")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sizes = clean.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.max(norm).alias("norm")).orderBy(F.desc("n"), F.desc("size")).first()
    size, longest = (sizes["size"], sizes["norm"]) if sizes else (1, 1.0)
    keys = [F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), F.col("v")).alias("k2")]
    clean = clean.where(F.size("v") == size)
    members = materialise(clean.select(*keys, "id", "query"))

    one = clean.select(*keys, F.struct("id", F.col("raw").alias("v")).alias("first"), F.col("query").cast("int").alias("query"))
    one = materialise(one.groupBy("k1", "k2").agg(F.min("first").alias("first"), F.max("query").alias("query")).select("k1", "k2", "first.id", "first.v", "query"))
    some = one.orderBy("k2", "k1").limit(SAMPLE).select("v").collect()  # SAMPLE rows
    if not some:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    some = far_apart(np.array([r.v for r in some], dtype=np.float64), pivots)
    chosen = spark.sparkContext.broadcast(Pivots(some, float(longest)))
    count = {r["query"]: r["count"] for r in one.groupBy("query").count().collect()}
    near = max(1, min(nearest, len(some) // 2))

    def packed(source: DataFrame, name: str, of: int, each: int, hashed: str, queries: bool) -> DataFrame:
        number = F.pmod(F.col(hashed), F.lit(max(1, -(-of // each)))).cast("int").alias(name)
        dealt = source.select(number, "k1", "k2", "id", "v").repartition(name).sortWithinPartitions(name, "k2", "k1")
        return materialise(dealt.mapInArrow(_packed(name, 2 * each, chosen, near, queries), PACKED.format(name)))

    index = packed(one, "ib", sum(count.values()), block, "k1", False)
    asked = packed(one.where("query = 1"), "qb", count.get(1, 0), QUERY_BLOCK, "k2", True)
    blocks = F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-sum(count.values()) // block) - 1))))
    asked = asked.select(F.struct(*asked.columns).alias("q"), blocks.alias("ib"))
    met = index.select("ib", F.struct(*index.columns).alias("i")).join(asked, "ib").select("i", "q")
    found = met.mapInArrow(_search(len(some), k + 1, reranked / max(1, sum(count.values())) ** 0.5), "q1 long, q2 long, k1 long, k2 long, id long, score double")
    best = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "id"))
    found = found.withColumn("__n", best).where(F.col("__n") <= k + 1)

    # an entry's ids: the smallest k + 1 are enough, as at most one of them is the query's own
    place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))
    ids = members.select("k1", "k2", "id").distinct().withColumn("__n", place).where(F.col("__n") <= k + 1)
    ids = ids.groupBy("k1", "k2").agg(F.collect_list("id").alias("ids"))
    lists = found.select("q1", "q2", "k1", "k2", "score").join(ids, ["k1", "k2"]).groupBy("q1", "q2").agg(F.collect_list(F.struct("score", "ids")).alias("hits"))
    flat = F.flatten(F.transform("hits", lambda h: F.transform(h["ids"], lambda i: F.struct((-h["score"]).alias("far"), i.alias("id")))))
    # a vector with two rows of one id keeps one; the same id with two vectors keeps the nearer
    lists = lists.select("q1", "q2", F.slice(F.sort_array(flat), 1, 2 * (k + 1)).alias("hits"))
    asking = members.where("query").select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("id").alias("query_id")).distinct()
    mine = asking.join(lists, ["q1", "q2"]).select("query_id", F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, k).alias("hits"))
    return mine.select("query_id", F.posexplode("hits").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (F.lit(0.0) - F.col("hit.far")).alias("score")
    )
