"""Near-duplicates by SimHash, made exact: close fingerprints propose links, the similarity of the word shingles
decides on them, and a prefix-filter join finds the pairs whose fingerprints lie too far apart, so that none is lost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from savorgrid.session import materialise

from .graph import components
from .simhash import fingerprints_of, near_links
from .textcore import LOWER, PrefixHash, chunks, freeing, mix, word_spans

CHUNK = 1 << 19  # bytes of text whose words are looked at together; the working arrays are some hundred times as large
CENTRES = 16  # texts of a bucket that are held against all others of it in the first round
SAMPLE = 100  # texts, on average, whose shingles are counted together, until there are 2**MOST_PARTS parts
MOST_PARTS = 11
COMMON = 200_000  # common shingles kept at most
STRETCH = 1 << 18  # shingles that are counted together before they are dealt out
BITS = 23  # at least: the bitmap by which texts of no candidate pair are passed over has 2**BITS bits, or 16 for each text that is in one
MOST_BITS = 29  # 64 MB; a fuller bitmap lets more texts through to the join, and loses none
PRINT_WORDS = 4  # words of the shingles that vote on a fingerprint
PRINT_RADIUS = 4  # bits by which fingerprints of a proposed link differ at most
SKETCH = 512  # bits at least that say of each residue whether a set has an odd number of shingles there
_STEP = np.uint64(0xD1B54A32D192ED03)


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, 64-bit shingle hashes, bounds): each text's different shingles, ascending.

    Words are lower-cased (ASCII) and end at white space; a text of fewer than ``width`` words is one shingle.
    """
    for first, last, buf, off in chunks(column, CHUNK):
        buf = LOWER[buf]
        starts, ends, word_at = word_spans(buf, off)
        words = PrefixHash(buf).spans(starts, ends) if len(starts) else np.zeros(0, np.uint64)
        n_words = np.diff(word_at)
        n = np.where(n_words > 0, np.maximum(1, n_words - width + 1), 0)
        row = np.repeat(np.arange(last - first), n)
        at = np.arange(len(row)) + np.repeat(word_at[:-1] - (np.cumsum(n) - n), n)
        hashes = np.zeros(len(row), dtype=np.uint64)
        for k in range(width):
            inside = at + k < word_at[row + 1]
            hashes[inside] = hashes[inside] * _STEP + words[at[inside] + k]
        hashes = mix(hashes)
        order = np.lexsort((hashes, row))
        hashes, row = hashes[order], row[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
        hashes, row = hashes[new], row[new]
        yield first, last, hashes, np.searchsorted(row, np.arange(last - first + 1))


def set_names(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for the empty one."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ _STEP), dtype=np.uint64)])
    size = np.diff(bounds).astype(np.uint64)
    return np.where(size > 0, mix(sums[bounds[1:]] - sums[bounds[:-1]] + size), np.uint64(0))


def sketches(hashes: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Parity bits of each set: as many as it has shingles, the next power of two, SKETCH at least. Two sets
    differ in at least as many shingles as their sketches in bits; fewer bits would fill up with a long text."""
    n = np.diff(bounds)
    bits = np.maximum(SKETCH, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(bits)])
    row = np.repeat(np.arange(len(n)), n)
    place = start[row] + (hashes & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.packbits((np.bincount(place, minlength=start[-1]) & 1).astype(bool)).tobytes()
    return [odd[a:b] for a, b in zip((start[:-1] // 8).tolist(), (start[1:] // 8).tolist(), strict=True)]


def _folded(words: np.ndarray, size: int) -> np.ndarray:
    """Sketches (a row each) as they would be with fewer bits."""
    while words.shape[1] > size:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def sketch_distance(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Bits in which two lists of sketches differ, pair by pair, at the shorter of the two sizes."""
    out = np.zeros(len(a), dtype=np.int64)
    sizes = np.array([[len(x) for x in a], [len(x) for x in b]], dtype=np.int64).T.reshape(-1, 2)
    for m, n in np.unique(sizes, axis=0).tolist():  # powers of two, so few
        at = np.flatnonzero((sizes == (m, n)).all(axis=1))
        for k in range(0, len(at), max(1, (4 << 20) // max(m, n))):
            some = at[k : k + max(1, (4 << 20) // max(m, n))]
            x, y = (np.frombuffer(b"".join(s[i] for i in some.tolist()), np.uint64).reshape(len(some), -1) for s in (a, b))
            size = min(m, n) // 8
            out[some] = np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum(axis=1)
    return out


def _least(n, similarity: float):
    """Shingles that a set of n shares at least with any set as similar as that."""
    return np.ceil(similarity * n - 1e-9).astype(np.int64)


def _named(width: int, text_at: int, keep: int):
    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, hashes, bounds in shingle_sets(batch.column(text_at), width):
                rest = [c.slice(first, last - first) for c in batch.columns[:keep]]
                prints = fingerprints_of(batch.column(text_at).slice(first, last - first), PRINT_WORDS).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(set_names(hashes, bounds).view(np.int64)), pa.array(np.diff(bounds).astype(np.int32)), pa.array(sketches(hashes, bounds), pa.binary()), pa.array(prints)],
                    names=[*batch.schema.names[:keep], "fp", "n", "sketch", "print"],
                )

    return run


def _all_shingles(width: int):
    """Shingles (h) and how many texts have them (n), added up over every stretch of a task, so that one that
    nearly all texts have is a row of each stretch."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], names=["h", "n"])

        for batch in batches:
            for _, _, hashes, _ in shingle_sets(batch.column(0), width):
                held.append(hashes)
                size += len(hashes)
                if size >= STRETCH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def name_bits(n_rows: int) -> int:
    """First bits of a hash by which shingles are dealt out to be counted; 32 more name them there."""
    return min(MOST_PARTS, (n_rows // SAMPLE).bit_length())


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends]) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _packed(width: int, bits: int):
    """The shingles of every stretch by their first bits (part): the next 32 of those that one text has (ones), and
    of those that several have, with their number (more). Four bytes for nearly all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(32)
        for rows in _all_shingles(width)(batches):  # ascending
            names, n = rows.column(0).to_numpy().view(np.uint64) >> np.uint64(32 - bits), rows.column(1).to_numpy()
            one = n == 1
            ones, more = names[one], names[~one]
            ends = [np.append(np.searchsorted(x, above), len(x)) for x in (ones, more)]
            pairs = np.stack([more.astype(np.uint32), n[~one].astype(np.uint32)], axis=1)
            out = [_binaries(ones.astype(np.uint32), ends[0]), _binaries(pairs.reshape(-1), 2 * ends[1])]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1 << bits, dtype=np.int32)), *out], names=["part", "ones", "more"])

    return run


def _counted():
    """Names of shingles, ascending, and how many texts have them (h, n), from packed parts that come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ones, more = None, [], []

        def flush() -> pa.RecordBatch:
            names, n = np.unique(np.concatenate([np.zeros(0, np.uint32), *ones]), return_counts=True)
            pairs = np.concatenate([np.zeros(0, np.uint32), *more]).reshape(-1, 2)
            if len(pairs):
                names, at = np.unique(np.concatenate([names, pairs[:, 0]]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, pairs[:, 1]]))
            return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64) + (last << 32)), pa.array(n.astype(np.int64))], names=["h", "n"])

        for batch in batches:
            for part, a, b in zip(*batch.columns, strict=True):
                part = part.as_py()
                if part != last and last is not None:
                    yield flush()
                    ones, more = [], []
                last = part
                # copies, as views would keep whole batches
                ones.append(np.frombuffer(a.as_buffer(), np.uint32).copy())
                more.append(np.frombuffer(b.as_buffer(), np.uint32).copy())
        if last is not None:
            yield flush()

    return run


def _frequent(least: int):
    """Shingles that ``least`` texts have or more (h, n); rows come sorted by shingle, the last one of a batch waits."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            h = np.concatenate([held[0], batch.column(0).to_numpy()])
            n = np.concatenate([held[1], batch.column(1).to_numpy().astype(np.int64)])
            if not len(h):
                continue
            first = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
            h, n = h[first], np.add.reduceat(n, first)
            held = h[-1:], n[-1:]
            often = np.flatnonzero(n[:-1] >= least)
            if len(often):
                yield pa.RecordBatch.from_arrays([pa.array(h[often]), pa.array(n[often])], names=["h", "n"])
        often = held[1] >= least
        yield pa.RecordBatch.from_arrays([pa.array(held[0][often]), pa.array(held[1][often])], names=["h", "n"])

    return run


def _prefixes(width: int, similarity: float, common: np.ndarray, bits: int):
    """Of every text the first shingles in a global order, common ones last: so many that two texts that are
    similar enough share one. ``common``: names (the first 32 + ``bits`` bits), from the less to the more common.
    """
    by_hash = np.argsort(common)
    known = common[by_hash]

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, hashes, bounds in shingle_sets(batch.column(0), width):
                n, names = np.diff(bounds), set_names(hashes, bounds)
                row = np.repeat(np.arange(len(n)), n)
                rank = np.zeros(len(hashes), dtype=np.int64)
                if len(known):
                    own = hashes >> np.uint64(32 - bits)
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    rank = np.where(known[at] == own, by_hash[at] + 1, 0)
                hashes = hashes[np.lexsort((hashes, rank, row))]
                place = np.arange(len(hashes)) - np.repeat(bounds[:-1], n)
                fresh = np.ones(len(n), dtype=bool)
                for i, x in enumerate(names.tolist()):
                    fresh[i] = x not in seen
                    seen.add(x)
                if len(seen) > 2_000_000:
                    seen.clear()
                take = (place < (n - _least(n, similarity) + 1)[row]) & fresh[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[take].view(np.int64)), pa.array(names[row[take]].view(np.int64)), pa.array(n[row[take]].astype(np.int32)), pa.array(place[take].astype(np.int32))],
                    names=["h", "fp", "n", "at"],
                )

    return run


POSTINGS = "h long, fp long, n int, at int, root long"
FOUND = "u long, v long, h long, fp long, n int, at int"


def _candidates(similarity: float, centres: int):
    """Rows come sorted by shingle. Of each bucket the first ``centres`` texts are paired with all later ones
    that are of another component and could be similar enough by size and place of the shingle (u, v). The
    other texts of the bucket go on to the next round, unless they are one component (h, fp, n, at)."""

    def pairs_of(fp, n, at, root):
        first = np.unique(fp, return_index=True)[1]  # sorted, so that buckets agree on the centres
        fp, n, at, root = fp[first], n[first], at[first], root[first]
        us, vs = [], []
        for k in range(min(centres, len(fp) - 1)):
            # as if nothing before this shingle were shared: of a pair's buckets, that of its first one must find it
            bound = np.minimum(n[k] - at[k], n[k + 1 :] - at[k + 1 :])
            ok = (root[k] != root[k + 1 :]) & (bound * (1 + similarity) >= similarity * (n[k] + n[k + 1 :]) - 1e-6)
            ok &= np.minimum(n[k], n[k + 1 :]) >= similarity * np.maximum(n[k], n[k + 1 :]) - 1e-6
            vs.append(fp[k + 1 :][ok])
            us.append(np.full(len(vs[-1]), fp[k]))
        left = slice(centres, None) if len(fp) > centres + 1 and (root[centres:] != root[-1]).any() else slice(0, 0)
        return us, vs, (fp[left], n[left], at[left])

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def flush(cols):
            h, fp, n, at, root = cols
            bounds = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
            us, vs, going = [], [], []
            for i in np.flatnonzero(np.diff(bounds) > 1):
                s = slice(bounds[i], bounds[i + 1])
                u, v, left = pairs_of(fp[s], n[s], at[s], root[s])
                us += u
                vs += v
                if len(left[0]):
                    going.append((np.full(len(left[0]), h[bounds[i]]), *left))
            u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (us, vs))
            more = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*going, strict=True)] if going else [np.zeros(0, np.int64)] * 4
            a, b = len(u), len(more[0])
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays(
                [
                    *[pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(b, pa.int64())]) for x in (u, v)],
                    *[pa.concat_arrays([pa.nulls(a, k), pa.array(x.astype(k.to_pandas_dtype()), k)]) for x, k in zip(more, kinds, strict=True)],
                ],
                names=["u", "v", "h", "fp", "n", "at"],
            )

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if last:
                yield flush([c[:last] for c in cols])
            held = [c[last:] for c in cols]
        if held is not None:
            yield flush(held)

    return run


def _wanted(pairs: DataFrame, named: DataFrame) -> np.ndarray:
    """A bitmap of the hashes of the texts that are in a pair, one text for each set name.

    Its parts are put together by partial aggregates; the driver gets at most 2**MOST_BITS bits.
    """
    names = pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
    texts = materialise(named.join(names, "fp", "left_semi").groupBy("fp").agg(F.min("h").alias("h")))
    n = texts.count()
    bits = min(MOST_BITS, max(BITS, (16 * n).bit_length()))
    place = F.shiftrightunsigned("h", 64 - bits) + 1  # the functions below count from 1
    parts = texts.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in parts.toLocalIterator():
        own = np.frombuffer(r.bits, dtype=np.uint8)
        out[(r.part - 1) * len(own) : r.part * len(own)] = own
    return out


def _sets_of(width: int, wanted: np.ndarray):
    """The sets of texts that may be in a candidate pair; the others' words are not looked at. Rows: text, its hash."""
    shift = np.uint64(64 - (8 * len(wanted)).bit_length() + 1)

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            place = batch.column(1).to_numpy().view(np.uint64) >> shift
            batch = batch.filter(pa.array((wanted[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0))
            for _, _, hashes, bounds in shingle_sets(batch.column(0), width):
                names = set_names(hashes, bounds)
                fps, sets = [], []
                for i in np.flatnonzero(np.diff(bounds) > 0):
                    if (x := int(names[i])) not in seen:
                        seen.add(x)
                        fps.append(names[i : i + 1].view(np.int64)[0])
                        sets.append(hashes[bounds[i] : bounds[i + 1]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(sets, pa.binary())], names=["fp", "set"])

    return run


def _near_sketches(similarity: float):
    """Pairs (u, v, their sizes and sketches) that may be similar enough; no pair that is gets lost."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            bits = sketch_distance(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            ok = bits * (1 + similarity) <= (1 - similarity) * n + 1e-6
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(ok))

    return run


def _verify(similarity: float):
    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = np.zeros(batch.num_rows, dtype=bool)
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                same[i] = both >= similarity * (len(a) + len(b) - both) - 1e-9
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(same))

    return run


def common_shingles(texts: DataFrame, width: int, n_rows: int) -> np.ndarray:
    """Names of shingles of several texts, from the less to the more common, counted over all texts.

    Names of 32 bits and a part's own, as only the order of shingles depends on them.
    """
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    packed = texts.mapInArrow(_packed(width, name_bits(n_rows)), "part int, ones binary, more binary")
    dealt = packed.repartition(parts, "part").sortWithinPartitions("part")
    counted, frequent = _counted(), _frequent(8)
    top = dealt.mapInArrow(lambda batches: frequent(counted(batches)), "h long, n long").orderBy(F.desc("n"), "h").limit(COMMON).select("h").toPandas()
    return top["h"].to_numpy(np.int64)[::-1].copy().view(np.uint64)


def fingerprint_pairs(named: DataFrame, radius: int = PRINT_RADIUS) -> DataFrame:
    """Pairs (u, v) of set names that join all texts whose SimHash fingerprints are within ``radius`` bits.

    Not all such pairs: texts of one fingerprint are paired with the first of them, and near fingerprints by
    links that span them, so a group of copies costs its size.
    """
    prints = materialise(named.where("n > 0").groupBy("fp").agg(F.min("print").alias("print")))
    first = materialise(prints.groupBy("print").agg(F.min("fp").alias("first")))
    same = prints.join(first, "print").where("fp <> first").select(F.col("first").alias("u"), F.col("fp").alias("v"))
    near = near_links(first.select(F.col("print").alias("fp")), radius).withColumnsRenamed({"u": "pu", "v": "pv"})
    for side in "uv":
        near = near.join(first.select(F.col("print").alias(f"p{side}"), F.col("first").alias(side)), f"p{side}")
    return near.select("u", "v").unionByName(same)


def similar_links(docs: DataFrame, named: DataFrame, text_col: str = "text", width: int = 5, similarity: float = 0.8, centres: int = CENTRES) -> DataFrame:
    """Links (u, v) between set names that join every two texts whose shingle sets have a Jaccard similarity
    of at least ``similarity``; every link is such a pair.

    ``named``: text_mark (h), fp, n, sketch and print of every text. Links of close fingerprints come first. Not
    all pairs: texts of one component are not compared again. A crowded bucket is worked off in rounds
    with more and more centres, so that a large group of near copies costs its size and not its square.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    texts = docs.select(F.col(text_col).alias("text"))
    sketched = materialise(named.select("fp", "n", "sketch").dropDuplicates(["fp"]))
    su, sv = (sketched.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "uv")

    def alike(pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose sets are similar enough."""
        pairs = pairs.distinct().join(su, "u").join(sv, "v").select("u", "v", "nu", "nv", "su", "sv")
        pairs = materialise(pairs.mapInArrow(_near_sketches(similarity), "u long, v long"))
        marked = texts.select("text", text_mark(F.col("text")).alias("h"))
        sets = marked.mapInArrow(_sets_of(width, _wanted(pairs, named)), "fp long, set binary").dropDuplicates(["fp"])
        both = pairs.join(sets.withColumnsRenamed({"fp": "u", "set": "su"}), "u").join(sets.withColumnsRenamed({"fp": "v", "set": "sv"}), "v")
        return materialise(both.select("u", "v", "su", "sv").mapInArrow(_verify(similarity), "u long, v long"))

    def rooted(postings: DataFrame) -> DataFrame:
        roots = components(links).withColumnsRenamed({"node": "fp"})
        return postings.select("h", "fp", "n", "at").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))

    links = alike(fingerprint_pairs(named))
    n_rows = named.count()
    common = common_shingles(texts, width, n_rows)
    postings = texts.mapInArrow(_prefixes(width, similarity, common, name_bits(n_rows)), "h long, fp long, n int, at int")
    postings = postings.withColumn("root", F.col("fp")) if links.isEmpty() else rooted(postings)
    while True:
        dealt = postings.repartition(parts, "h").sortWithinPartitions("h").select("h", "fp", "n", "at", "root")
        found = materialise(dealt.mapInArrow(_candidates(similarity, centres), FOUND))
        links = links.unionByName(alike(found.where("u is not null").select("u", "v")))
        going = found.where("h is not null")
        if going.isEmpty():
            return links
        postings = materialise(rooted(going))
        centres *= 4


def text_mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each component of texts that are linked by a Jaccard similarity of at least ``similarity``
    between their sets of ``width``-word shingles: the one with the smallest id, null ids last.

    Texts without words are equal. The rows are found again by id and text hash, so no copy of the texts is written.
    """
    mark = text_mark(F.col(text_col))
    own = docs.select(F.col(id_col).alias("__i"), mark.alias("h"), F.col(text_col).alias("__x"))
    fields = "__i {}, h long, fp long, n int, sketch binary, print long".format(docs.schema[id_col].dataType.simpleString())
    named = materialise(own.mapInArrow(_named(width, 2, 2), fields))
    roots = components(similar_links(docs, named, text_col, width, similarity))
    rows = named.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = F.min(F.struct(F.col("__i").isNull().alias("none"), F.col("__i").alias("id"), F.col("h")))
    stay = rows.groupBy("root").agg(first.alias("least")).select(F.col("least.id").alias("__keep"), F.col("least.h").alias("__h"))
    stay = materialise(stay)
    marked = docs.withColumn("__mark", mark)
    kept = marked.join(stay, (F.col("__mark") == F.col("__h")) & marked[id_col].eqNullSafe(F.col("__keep")), "left_semi")
    one = F.row_number().over(Window.partitionBy("__mark", id_col).orderBy(F.lit(0)))
    return kept.withColumn("__n", one).where("__n = 1").select(docs.columns)
