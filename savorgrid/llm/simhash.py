"""SimHash near-dedup with covering locality-sensitive hashing (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from savorgrid.session import materialise

from .graph import components
from .textcore import LOWER, chunks, word_spans

SEED = 42
BUCKET_ROWS = 4096  # fingerprints compared at once; a fuller bucket is covered once more


def fingerprints_of(column: pa.Array, width: int) -> np.ndarray:
    """64-bit SimHash of every text: bit set if set in over half the XXH64 hashes of its word shingles."""
    out = np.zeros(len(column), dtype=np.uint64)
    for first, last, buf, off in chunks(column, 2 << 20):
        buf = LOWER[buf]
        starts, ends, word_at = word_spans(buf, off)
        if not len(starts):
            continue
        # the words of the chunk, joined by single spaces
        lengths = ends - starts
        place = np.concatenate([[0], np.cumsum(lengths + 1)])
        flat = np.full(place[-1], 0x20, dtype=np.uint8)
        flat[np.arange(lengths.sum()) + np.repeat(np.arange(len(lengths)), lengths)] = buf[
            np.arange(lengths.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        ]
        flat = flat.tobytes()
        digest = xxhash.xxh64_intdigest
        for i in range(last - first):
            a, b = int(word_at[i]), int(word_at[i + 1])
            if a == b:
                continue
            n = max(1, b - a - width + 1)
            lo, hi = place[a : a + n].tolist(), (place[np.minimum(np.arange(a, a + n) + width, b)] - 1).tolist()
            votes = np.zeros(64, dtype=np.int64)
            for k in range(0, n, 65536):
                hashes = np.array([digest(flat[s:e], SEED) for s, e in zip(lo[k : k + 65536], hi[k : k + 65536], strict=True)], dtype=np.uint64)
                votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[first + i] = np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", width: int = 4, keep_text: bool = False) -> DataFrame:
    """``docs``, without the text unless it is kept, with ``fp``: the fingerprint as a signed long."""
    rest = [c for c in docs.columns if c != "fp" and (keep_text or c != text_col)]
    order = rest if keep_text else [*rest, text_col]
    at = order.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints_of(batch.column(at), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(fp)], names=[*rest, "fp"])

    return docs.select(*order).mapInArrow(run, StructType([*docs.select(*rest).schema.fields, StructField("fp", LongType())]))


def covering_masks(radius: int, seed: int) -> list[int]:
    """2**(radius+1) - 1 bit masks of which, for any ``radius`` bit positions, at least one avoids them all.

    Every position gets a vector of radius + 1 random bits; the mask of a non-zero vector v holds the
    positions whose vector has an odd product with v. ``radius`` vectors cannot span the space, so some v
    has an even product with all of them. No vector is zero, so every position is in half of the masks.
    """
    vectors = np.random.default_rng(seed).integers(1, 1 << (radius + 1), 64)
    return [sum(1 << i for i, x in enumerate(vectors) if bin(int(x) & v).count("1") & 1) for v in range(1, 1 << (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(radius: int):
    def of_bucket(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spanning links of the fingerprints of one bucket: nearest reached first, block by block."""
        open_, us, vs = fps.copy(), [], []
        while len(open_) > 1:  # breadth first from the first open one
            front, open_ = open_[:1], open_[1:]
            while len(front) and len(open_):
                close = np.bitwise_count(open_[:, None] ^ front[None, :64]) <= radius
                hit = close.any(axis=1)
                us.append(front[:64][close[hit].argmax(axis=1)])
                vs.append(open_[hit])
                front, open_ = np.concatenate([front[64:], open_[hit]]), open_[~hit]
        none = np.zeros(0, dtype=np.uint64)
        return np.concatenate([none, *us]), np.concatenate([none, *vs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; the last bucket of a batch waits for the next."""
        held = None

        def flush(keys, fps):
            if not len(fps):
                return None
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            bounds = np.concatenate([[0], cuts, [len(fps)]])
            size = np.diff(bounds)
            us, vs = [], []
            two = bounds[:-1][size == 2]  # most buckets with company hold two
            near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius
            us.append(fps[two][near])
            vs.append(fps[two + 1][near])
            for i in np.flatnonzero(size > 2):
                u, v = of_bucket(fps[bounds[i] : bounds[i + 1]])
                us.append(u)
                vs.append(v)
            u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns - 1)], axis=1)
            fps = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64)
            if held is not None:
                keys, fps = np.concatenate([held[0], keys]), np.concatenate([held[1], fps])
            if not len(fps):
                continue
            last = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 if (keys != keys[-1]).any() else 0
            if last and (out := flush(keys[:last], fps[:last])) is not None:
                yield out
            held = keys[last:], fps[last:]
        if held is not None and (out := flush(*held)) is not None:
            yield out

    return run


def near_links(fps: DataFrame, radius: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (u, v) that join every two of the distinct fingerprints ``fp`` within ``radius`` bits.

    Not all pairs: in a bucket only enough links to connect what is near. A bucket of more than
    ``bucket_rows`` fingerprints is covered again by other masks, which fix more of the bits; each level
    loses no pair, and the bits left free soon number fewer than a bucket holds.
    """
    out, rows, keys, level = None, fps.select("fp"), [], 0
    while True:
        masks = covering_masks(radius, seed=level + 1)
        table = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks]))
        new = [f"t{level}", f"k{level}"]
        rows = rows.select("fp", *keys, table.alias(*new))
        # one long for the table and the kept bits; the kept bits themselves are compared in the bucket
        rows = rows.withColumn(new[0], F.col(new[0]).cast("long"))
        keys = keys + new
        sizes = rows.groupBy(*keys).count().where("count > 1")
        sizes = materialise(sizes)
        full = sizes.where(F.col("count") > bucket_rows).drop("count")
        more = level < 5 and not full.isEmpty()
        small = rows.join(sizes.where(F.col("count") <= bucket_rows).drop("count") if more else sizes.drop("count"), keys, "left_semi")
        parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
        links = small.select(*keys, "fp").repartition(parts, *keys).sortWithinPartitions(*keys, "fp").mapInArrow(_links(radius), "u long, v long")
        links = materialise(links)
        out = links if out is None else out.unionByName(links)
        if not more:
            return out
        rows = materialise(rows.join(full, keys, "left_semi"))
        level += 1


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """The row of each component that ``near_duplicates`` says stays, with the columns of ``docs``.

    The rows are found again by id and text hash, so no copy of the texts is written.
    """
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    found = near_duplicates(docs.select(F.col(id_col).alias("__i"), F.col(text_col).alias("__x"), mark.alias("__h")), "__i", "__x", width, radius, carry=["__i", "__h"])
    stay = found.where("stays").select(F.col("__i").alias("__keep"), "__h")
    rows = docs.withColumn("__mark", mark)
    kept = rows.join(stay, (F.col("__mark") == F.col("__h")) & rows[id_col].eqNullSafe(F.col("__keep")), "left_semi")
    one = F.row_number().over(Window.partitionBy("__mark", id_col).orderBy(F.lit(0)))
    return kept.withColumn("__n", one).where("__n = 1").select(docs.columns)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, carry: list[str] | None = None) -> DataFrame:
    """The documents with ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable over links
    of at most ``radius`` differing bits, its own included) and ``stays`` (true for one row of a component).

    Equal fingerprints collapse before the covering tables, so copies cost nothing there. A text without
    words (empty, blank or null) has fingerprint zero and is linked like any other. The row with the
    component's id stays; null ids come last, and a component of null ids alone gets null; of rows that
    share the id the first read stays. An empty table gives no rows; clashing columns are replaced.
    ``carry``: the columns to bring along, all by default.
    """
    added = ["fingerprint", "component_id", "stays"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in added]
    own = [f"c_{i}" for i in range(len(carry))]
    key = docs.select(*[F.col(c).alias(o) for c, o in zip(carry, own, strict=True)], F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))
    text = f"c_{carry.index(text_col)}" if text_col in carry else None
    if text:
        key = key.drop("__t")
    rows = materialise(fingerprints(key, text or "__t", width, keep_text=bool(text)).withColumn("__row", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row")))
    fps = materialise(rows.groupBy("fp").agg(first.alias("least")))
    roots = components(near_links(fps, radius))
    fps = materialise(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = materialise(fps.groupBy("root").agg(F.min("least").alias("of_all")))
    of_fp = materialise(fps.join(least, "root").select("fp", "of_all"))
    return rows.join(of_fp, "fp").select(
        *[F.col(o).alias(c) for c, o in zip(carry, own, strict=True)],
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("of_all.id").alias("component_id"),
        (F.col("__row") == F.col("of_all.row")).alias("stays"),
    )
