"""Sharding by histogram sort (operator 2)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from savorgrid.session import materialise

HALF = 1 << 63
TOP = (1 << 128) - 1


def _join(hi: int, lo: int) -> int:
    """A key as one unsigned 128-bit number."""
    return ((hi + HALF) << 64) | (lo + HALF)


def _pairs(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return (
        np.array([(k >> 64) - HALF for k in keys], dtype=np.int64),
        np.array([(k & ((1 << 64) - 1)) - HALF for k in keys], dtype=np.int64),
    )


def _bins(hi: np.ndarray, lo: np.ndarray, cut_hi: np.ndarray, cut_lo: np.ndarray) -> np.ndarray:
    """For each key the number of sorted cuts that are not above it."""
    left, right = np.searchsorted(cut_hi, hi, "left"), np.searchsorted(cut_hi, hi, "right")
    out = left.copy()
    tied = left < right
    for at in np.unique(left[tied]):  # a cut inside a group of equal texts
        rows = tied & (left == at)
        out[rows] = at + np.searchsorted(cut_lo[at : right[rows][0]], lo[rows], "right")
    return out


def _counter(cuts: list[int]):
    cut_hi, cut_lo = _pairs(cuts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, rows = np.zeros(len(cuts) + 1, dtype=np.int64), np.zeros(len(cuts) + 1, dtype=np.int64)
        for b in batches:
            at = _bins(b["hi"].to_numpy(), b["lo"].to_numpy(), cut_hi, cut_lo)
            np.add.at(size, at, b["size"].to_numpy())
            rows += np.bincount(at, minlength=len(rows))
        full = np.flatnonzero(rows)
        yield pd.DataFrame({"bin": full, "size": size[full], "rows": rows[full]})

    return run


def splitters(keys: DataFrame, shards: int, tolerance: float = 0.01, probes: int = 64) -> list[int]:
    """Keys that divide ``keys`` (hi long, lo long, size long) into ``shards`` parts of nearly equal size.

    Each round counts the exact size below ``probes`` candidates in every open splitter's interval, in one
    pass with partial sums by task; the driver sees one number for each candidate. A candidate within
    ``tolerance`` of a shard is taken; else its interval narrows to the two candidates around the target.
    Candidates lie between groups of equal ``hi`` until an interval is down to one such group; only then
    is the group itself divided, by ``lo``. An interval with a single row ends at its nearer side.
    """
    total, count = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    slack = tolerance * total / shards
    targets = [total * j / shards for j in range(1, shards)]
    # an interval's two ends: key, and the size and rows below it
    open_ = {j: ((0, 0, 0), (TOP + 1, total, count)) for j in range(shards - 1)}
    done: dict[int, int] = {}
    while open_:
        wanted: dict[int, list[int]] = {}
        for j, ((a, *_), (b, *_)) in open_.items():
            first, last = (a >> 64) + 1, (b - 1) >> 64  # groups that begin inside
            if first <= last:
                n = min(probes, last - first + 1)
                wanted[j] = sorted({(first + (last - first) * i // max(1, n - 1)) << 64 for i in range(n)})
            else:
                n = min(probes, b - a - 1)
                wanted[j] = sorted({a + (b - a) * i // (n + 1) for i in range(1, n + 1)} - {a})
        cuts = sorted({c for cs in wanted.values() for c in cs})
        sizes, rows = np.zeros(len(cuts) + 1, dtype=np.int64), np.zeros(len(cuts) + 1, dtype=np.int64)
        if cuts:
            counted = keys.mapInPandas(_counter(cuts), "bin long, size long, rows long").groupBy("bin").agg(F.sum("size"), F.sum("rows"))
            for bin_, size, n in counted.collect():  # a row for each candidate at most
                sizes[bin_], rows[bin_] = size, n
        below = dict(zip(cuts, zip(np.cumsum(sizes).tolist(), np.cumsum(rows).tolist()), strict=False))
        for j in list(open_):
            low, high = open_[j]
            for c in wanted[j]:
                if below[c][0] > targets[j]:
                    high = (c, *below[c])
                    break
                low = (c, *below[c])
            near, gap = min(((end[0], abs(targets[j] - end[1])) for end in (low, high)), key=lambda x: x[1])
            if gap <= slack or high[0] - low[0] <= 1 or high[2] - low[2] <= 1:
                done[j] = min(near, TOP)
                del open_[j]
            else:
                open_[j] = (low, high)
    return [done[j] for j in range(shards - 1)]


def shard_by_bytes(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16,
    tolerance: float = 0.01, piece_bytes: int = 256 << 20,
) -> DataFrame:
    """The documents with ``size`` (UTF-8 bytes of the text plus ``overhead``), ``shard`` and ``slot``.

    Shards are ranges of (text hash, id hash), of sizes equal to about ``tolerance`` or to one row. Equal
    texts lie together; a group is divided only where it would upset the sizes. The splitters come from a
    small written table of keys; then the rows are exchanged once, to pieces of a shard of about
    ``piece_bytes``, and numbered there from the piece's exact offset. Slots of a shard run from 0 without
    gaps.

    A null text counts as empty; null ids are a value of their own; rows equal in id and text stay in
    one shard. Fewer rows than shards leave shards empty, an empty table gives an empty result. Columns
    called like the added ones are replaced.
    """
    added = ["size", "shard", "slot"]
    rest = [c for c in docs.columns if c not in added]
    text = F.coalesce(F.col(text_col), F.lit(""))
    hi, lo = F.xxhash64(text), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    size = (F.octet_length(text) + F.lit(overhead)).cast("long")
    keys = materialise(docs.select(hi.alias("hi"), lo.alias("lo"), size.alias("size")))
    cuts = splitters(keys, shards, tolerance)
    cut_hi, cut_lo = _pairs(cuts)
    per_shard = math.ceil((keys.agg(F.sum("size")).first()[0] or 0) / shards / piece_bytes) or 1

    shard = _shard_column(cut_hi.tolist(), cut_lo.tolist())
    piece = (F.col("shard") * per_shard + F.pmod(F.col("lo"), F.lit(per_shard))).cast("int").alias("piece")
    counts = keys.select("lo", shard.alias("shard")).select("shard", piece).groupBy("shard", "piece").count()
    offsets = materialise(
        counts.select("piece", (F.sum("count").over(Window.partitionBy("shard").orderBy("piece")) - F.col("count")).alias("__offset"))
    )
    rows = docs.select(*rest, size.alias("size"), hi.alias("__hi"), lo.alias("__lo"))
    rows = rows.withColumn("shard", _shard_column(cut_hi.tolist(), cut_lo.tolist(), "__hi", "__lo"))
    rows = rows.withColumn("__piece", (F.col("shard") * per_shard + F.pmod(F.col("__lo"), F.lit(per_shard))).cast("int"))
    rows = rows.repartitionById(max(2, shards * per_shard), F.col("__piece"))  # one piece a task
    place = F.row_number().over(Window.partitionBy("__piece").orderBy("__hi", "__lo"))
    rows = rows.withColumn("__place", place).join(offsets.withColumnRenamed("piece", "__piece"), "__piece")
    return rows.select(*rest, "size", "shard", (F.col("__offset") + F.col("__place") - 1).cast("long").alias("slot"))


def _shard_column(cut_hi: list[int], cut_lo: list[int], hi: str = "hi", lo: str = "lo") -> Column:
    """Number of cuts not above (hi, lo), by binary search written out as nested conditions."""

    def below(i: int, j: int) -> Column:
        if i == j:
            return F.lit(i)
        m = (i + j) // 2
        above = (F.col(hi) > cut_hi[m]) | ((F.col(hi) == cut_hi[m]) & (F.col(lo) >= cut_lo[m]))
        return F.when(above, below(m + 1, j)).otherwise(below(i, m))

    return below(0, len(cut_hi))
