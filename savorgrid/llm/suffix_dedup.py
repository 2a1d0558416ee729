"""Removal of long repeated byte strings by sorting suffixes (operator 10)."""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savorgrid.session import materialise, new_folder

from .textcore import PrefixHash, chunks, freeing, word_spans

GRAM = 96  # bytes of an anchor
SHALLOW = 64  # bytes sorted by multikey quicksort before blind tries take over
GROUP_ROWS = 4096  # different strings around one anchor that are sorted in one task
CODE = 8  # bytes that stand for a word where passages are measured in words
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# -- deep-shallow sorting ----------------------------------------------------------------------------


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] is common, a[:hi] is not
    while hi - lo > 1:
        m = (lo + hi) // 2
        if a[lo:m] == b[lo:m]:
            lo = m
        else:
            hi = m
    return lo


class BlindTrie:
    """A trie that keeps only where its strings branch; a string is compared once when it is added."""

    def __init__(self, strings: list[bytes], first: int):
        self.strings, self.root = strings, first

    def add(self, s: int) -> None:
        text, node = self.strings[s], self.root
        path = []
        while not isinstance(node, int):  # blindly down to any leaf
            path.append(node)
            depth, kids = node
            key = text[depth] if depth < len(text) else -1
            node = kids[key] if key in kids else next(iter(kids.values()))
        n = common(text, self.strings[node])
        mine = text[n] if n < len(text) else -1
        parent = None
        for step in path:  # down again to the edge on which they part
            if step[0] >= n:
                break
            parent = step
        below = self.root if parent is None else parent[1][text[parent[0]] if parent[0] < len(text) else -1]
        if not isinstance(below, int) and below[0] == n:
            below[1][mine] = s
            return
        other = self.strings[node]
        theirs = other[n] if n < len(other) else -1
        branch = (n, {theirs: below, mine: s})
        if parent is None:
            self.root = branch
        else:
            parent[1][text[parent[0]] if parent[0] < len(text) else -1] = branch

    def walk(self) -> tuple[list[int], list[int]]:
        """Strings in order, and the common prefix of each with the one before (0 for the first)."""
        order, shared = [], []
        stack = [(self.root, 0)]
        while stack:
            node, before = stack.pop()
            if isinstance(node, int):
                order.append(node)
                shared.append(before)
                continue
            depth, kids = node
            keys = sorted(kids)
            for k in reversed(keys[1:]):
                stack.append((kids[k], depth))
            stack.append((kids[keys[0]], before))
        return order, shared


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Order of different strings, and the common prefix of each with the one before it.

    Multikey quicksort, eight bytes at a time, to the shallow depth; a group that is still equal there
    goes into a blind trie. The end of a string sorts first.
    """
    order: list[int] = []
    shared: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        items, depth = stack.pop()
        if len(items) == 1:
            found, near = items, [0]
        elif depth >= shallow or any(len(strings[i]) <= depth for i in items):
            trie = BlindTrie(strings, items[0])
            for i in items[1:]:
                trie.add(i)
            found, near = trie.walk()
        else:
            pivot = strings[items[len(items) // 2]][depth : depth + 8]
            less, same, more = [], [], []
            for i in items:
                key = strings[i][depth : depth + 8]
                (same if key == pivot else less if key < pivot else more).append(i)
            if more:
                stack.append((more, depth))
            stack.append((same, depth + 8))
            if less:
                stack.append((less, depth))
            continue
        if order:
            near[0] = common(strings[order[-1]], strings[found[0]])
        order += found
        shared += near
    return order, shared


def repeated_around(parts: list[tuple[bytes, bytes]], width: int) -> list[tuple[int, int]]:
    """For different (left reversed, right) contexts of one anchor: how far the strings of ``width`` bytes
    that also occur around another reach to the left and to the right; (0, 0) where there is none.

    Two contexts that agree on l bytes to the left and r to the right share such strings if l + r is at
    least the width. The lefts are sorted, and their tree is climbed from long common contexts to short
    ones; on the way the sets below are merged, smaller into larger, in the order of the sorted rights. A
    new neighbour in that order has the longest common right part among those not yet met at a longer
    common left part, so no other pair is needed.
    """
    best = [[0, 0] for _ in parts]

    def meet(i: int, j: int, left: int) -> None:
        right = common(parts[i][1], parts[j][1])
        if left + right >= width:
            for x in (best[i], best[j]):
                x[0] = max(x[0], left)
                x[1] = max(x[1], right)

    if len(parts) == 2:
        meet(0, 1, common(parts[0][0], parts[1][0]))
        return [tuple(x) for x in best]
    by_right, _ = _sorted([r for _, r in parts])
    rank = [0] * len(parts)
    for at, i in enumerate(by_right):
        rank[i] = at
    by_left, shared = _sorted([x for x, _ in parts])
    owner = list(range(len(parts)))
    sets = {i: [rank[i]] for i in range(len(parts))}

    def root(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    for at in sorted(range(1, len(parts)), key=lambda k: -shared[k]):
        left = shared[at]
        a, b = root(by_left[at - 1]), root(by_left[at])
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        big = sets[a]
        for r in sets.pop(b):
            k = bisect_left(big, r)
            if k:
                meet(by_right[r], by_right[big[k - 1]], left)
            if k < len(big):
                meet(by_right[r], by_right[big[k]], left)
            big.insert(k, r)
        owner[b] = a
    return [tuple(x) for x in best]


def _sorted(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """deep_shallow for strings of which some are equal."""
    places: dict[bytes, list[int]] = {}
    for i, s in enumerate(strings):
        places.setdefault(s, []).append(i)
    different = list(places)
    order, shared = deep_shallow(different)
    out, near = [], []
    for k, n in zip(order, shared, strict=True):
        own = places[different[k]]
        out += own
        near += [n, *[len(different[k])] * (len(own) - 1)]
    return out, near


# -- anchors -----------------------------------------------------------------------------------------


def anchors(buf: np.ndarray, off: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first, last): every string of ``width`` bytes picks the ``gram`` bytes of least hash
    inside it, the last of equal ones. Strings first..last are the consecutive ones that pick a position.

    The choice depends on the string alone, so equal strings pick the same place.
    """
    none = np.zeros(0, dtype=np.int64)
    out = [(np.zeros(0, np.uint64), none, none, none)]
    span = width - gram + 1
    step = 1 << 22
    inside = np.zeros(len(buf) + 1, dtype=np.int32)
    fits = np.diff(off) >= width
    np.add.at(inside, off[:-1][fits], 1)
    np.add.at(inside, off[1:][fits] - width + 1, -1)
    inside = np.cumsum(inside)[: len(buf)] > 0
    for p0 in range(0, len(buf), step):
        part = buf[p0 : p0 + step + width - 1]
        if len(part) < width:
            break
        h = PrefixHash(part).windows(gram)
        place = np.arange(len(h), dtype=np.uint64)
        key = (h & ~np.uint64((1 << 24) - 1)) | (np.uint64((1 << 24) - 1) - place)
        rows = -(-len(key) // span)
        grid = np.full(rows * span, np.iinfo(np.uint64).max, dtype=np.uint64)
        grid[: len(key)] = key
        grid = grid.reshape(rows, span)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(part) - width + 1
        least = np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])
        picked = (np.uint64((1 << 24) - 1) - (least & np.uint64((1 << 24) - 1))).astype(np.int64)
        starts = np.flatnonzero(inside[p0 : p0 + n])
        if not len(starts):
            continue
        picked = picked[starts]
        new = np.flatnonzero(np.concatenate([[True], (picked[1:] != picked[:-1]) | (np.diff(starts) > 1)]))
        last = np.concatenate([new[1:], [len(starts)]]) - 1
        at = picked[new]
        out.append((h[at], at + p0, starts[new] + p0, starts[last] + p0))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@freeing
def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each tid in a task."""
    seen: set[bytes] = set()
    for batch in batches:
        take = []
        for i, t in enumerate(batch.column(0).to_pylist()):
            if t not in seen:
                seen.add(t)
                take.append(i)
        yield batch.take(pa.array(take, pa.int64()))


def word_codes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with every word replaced by its hash, and their offsets: white space and word length do not count."""
    starts, ends, word_at = word_spans(buf, off)
    codes = PrefixHash(buf).spans(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return codes.view(np.uint8), word_at * CODE


def _find_anchors(width: int, gram: int, words: bool = False):
    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, buf, off in chunks(batch.column(1), 1 << 20 if words else 2 << 20):
                if words:
                    buf, off = word_codes(buf, off)
                h, at, lo, hi = anchors(buf, off, width, gram)
                row = np.searchsorted(off, lo, "right") - 1
                base = off[row]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(first + row)), pa.array(h.view(np.int64)),
                        pa.array((at - base).astype(np.int64)), pa.array((lo - base).astype(np.int64)), pa.array((hi - base).astype(np.int64)),
                    ],
                    names=["tid", "h", "at", "lo", "hi"],
                )

    return run


def _cut_contexts(width: int, rows: int = 20_000, words: bool = False):
    """The bytes around each anchor that repeats: from the first string that picks it to the end of the last.
    With ``words`` places count in word codes, and the bytes are those of the words; ``_coded`` turns them to codes.

    Equal ones that come together (a text that repeats itself, copies of a passage in one task) are known to be
    repeated; one of them goes on as a context, the others' spans come out as rows without an anchor.
    """

    def flush(found: list[tuple]) -> pa.RecordBatch:
        same: dict[tuple[int, int, bytes], list[tuple]] = {}
        for tid, h, at, lo, n, data, hot in found:
            same.setdefault((h, at - lo, n, lo % CODE if words else 0, data), []).append((tid, at, lo, hot))
        out, known = [], {}
        for (h, _, n, _, data), places in same.items():
            tid, at, lo, hot = places[0]
            out.append((tid, h, at, lo, data, n, hot, None, None))
            if len(places) > 1:
                for tid, _, lo, _ in places:
                    known.setdefault(tid, []).append((lo, lo + n))
        for tid, spans in known.items():
            out += [(tid, None, None, None, None, None, None, a, b) for a, b in merge_spans(spans)]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        columns = zip(*out, strict=True) if out else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=["tid", "h", "at", "lo", "bytes", "n", "hot", "a", "b"])

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for tid, text, spots in zip(*[batch.column(i) for i in range(3)], strict=True):
                tid, raw = tid.as_py(), text.as_py().encode()
                if words:
                    starts, ends, _ = word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                for x in spots.as_py():
                    a, b = x["lo"], x["hi"] + width
                    data = raw[starts[a // CODE] : ends[-(-b // CODE) - 1]] if words else raw[a:b]
                    found.append((tid, x["h"], x["at"], a, b - a, data, x["hot"]))
                    if len(found) >= rows:
                        yield flush(found)
                        found = []
            yield flush(found)

    return run


@freeing
def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts with their words replaced by codes, from the place where the context begins within a code."""
    for batch in batches:
        names = batch.schema.names
        start, data = [x % CODE for x in batch.column(names.index("lo")).to_pylist()], []
        size = batch.column(names.index("n")).to_pylist()
        for first, last, buf, off in chunks(batch.column(names.index("bytes")), 2 << 20):
            codes, at = word_codes(buf, off)
            codes = codes.tobytes()
            data += [codes[at[i] + start[first + i] : at[i] + start[first + i] + size[first + i]] for i in range(last - first)]
        columns = list(batch.columns)
        columns[names.index("bytes")] = pa.array(data, pa.binary())
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _match(width: int, words: bool = False):
    """Rows come sorted by anchor; an anchor's rows are decided together."""

    def decide(rows: list[tuple]) -> list[tuple[bytes, int, int]]:
        if len(rows) < 2:
            return []
        same: dict[tuple[bytes, bytes], list[tuple]] = {}
        for tid, _, at, lo, data in rows:
            same.setdefault((data[: at - lo][::-1], data[at - lo :]), []).append((tid, at, lo, len(data)))
        parts = list(same)
        reach = repeated_around(parts, width) if len(parts) > 1 and any(len(v) == 1 for v in same.values()) else [(0, 0)] * len(parts)
        out = []
        for part, (left, right) in zip(parts, reach, strict=True):
            places = same[part]
            if len(places) > 1:  # all its strings are repeated
                out += [(tid, lo, lo + n) for tid, _, lo, n in places]
            elif right:
                tid, at, _, _ = places[0]
                out.append((tid, at - left, at + right))
        return out

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in _coded(batches) if words else batches:
            found: list[tuple[bytes, int, int]] = []
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for row in zip(*columns, strict=True):
                if group and row[1] != group[0][1]:
                    found += decide(group)
                    group = []
                group.append(row)
            yield _spans(found)
        yield _spans(decide(group))

    return run


def _spans(found: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    t, a, b = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(t, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["tid", "a", "b"])


def _ranges(width: int, gram: int, ways: int = 4):
    """Rows of crowded anchors by ranges of strings, told apart by how far left of the anchor they start.

    A row comes with a range and leaves with its parts (or itself, at first). For each part: ``core``, the
    digest of the bytes that all strings of the range have in common places, so that equal strings meet
    under one core; ``whole``, the digest of all bytes of the row's strings in the range; and the span a to b
    of those strings.
    """

    def digest(*parts: bytes) -> bytes:
        d = hashlib.blake2b(digest_size=16)
        for x in parts:
            d.update(len(x).to_bytes(8, "little") + x)
        return d.digest()

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(11)]
            for tid, h, at, lo, data, near, far in zip(*[batch.column(i).to_pylist() for i in range(7)], strict=True):
                left, right = at - lo, len(data) - (at - lo)  # bytes on either side
                if near is None:
                    parts = [(0, width - gram)]
                else:
                    step = -(-(far - near + 1) // ways)
                    parts = [(n, min(far, n + step - 1)) for n in range(near, far + 1, step)]
                for n, f in parts:
                    first, last = max(n, width - right), min(f, left)  # the strings this row has
                    if first > last:
                        continue
                    own = data[left - last : left - first + width]
                    core = digest(h.to_bytes(8, "little", signed=True), data[left - n : left], data[left : left + width - f])
                    row = tid, h, at, lo, data, n, f, core, digest(last.to_bytes(8, "little"), own), at - last, at - first + width
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
            long, raw = pa.int64(), pa.binary()
            kinds = [raw, long, long, long, raw, long, long, raw, raw, long, long]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(out, kinds, strict=True)],
                names=["tid", "h", "at", "lo", "bytes", "near", "far", "core", "whole", "a", "b"],
            )

    return run


RANGED = "tid binary, h long, at long, lo long, bytes binary, near long, far long, core binary, whole binary, a long, b long"


def _crowded_spans(contexts: DataFrame, width: int, gram: int, group_rows: int, parts: int) -> DataFrame:
    """Spans around anchors with very many contexts, without a large group in any task.

    In rounds: rows whose bytes are equal over the whole range are repeated there, and one of them goes on
    for the others. Rows left alone under their core are unique. A core with few rows is sorted like any
    other anchor; the range of a core with many is cut in four, which fixes more bytes of the core. A
    range of one string ends the rounds, as its core is the string itself.
    """
    rows = contexts.select("tid", "h", "at", "lo", "bytes", F.lit(None).cast("long").alias("near"), F.lit(None).cast("long").alias("far"))
    out = None
    while True:
        rows = materialise(rows.mapInArrow(_ranges(width, gram), RANGED))
        whole = materialise(
            rows.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("tid", "at")).alias("one"))
        )
        cores = materialise(whole.groupBy("core").count().where("count > 1").select("core", (F.col("count") > group_rows).alias("many")))
        known = rows.join(whole, ["core", "whole"])
        same = known.where("n > 1").select("tid", "a", "b")
        going = known.where((F.col("n") == 1) | (F.struct("tid", "at") == F.col("one"))).join(cores, "core")
        going = materialise(going.select("tid", "core", "h", "at", "lo", "bytes", "near", "far", "many"))
        few = going.where("not many").select("tid", "core", "at", "lo", "bytes").repartition(parts, "core").sortWithinPartitions("core")
        found = materialise(same.unionByName(few.mapInArrow(_match(width), "tid binary, a long, b long")))
        out = found if out is None else out.unionByName(found)
        rows = going.where("many and near < far").select("tid", "h", "at", "lo", "bytes", "near", "far")
        if rows.isEmpty():
            return out


SPAN = "array<struct<a: bigint, b: bigint>>"
FOUND = f"tid binary, spans {SPAN}, passages {SPAN}, n_removed long, kept_sha256 string"


@freeing
def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for tid, text, spans in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            raw = text.encode()
            merged = merge_spans([(s["a"], s["b"]) for s in spans if not s["words"]])
            passages = _of_words(raw, [(s["a"], s["b"]) for s in spans if s["words"]])
            kept = cut(raw, merged)
            row = tid, [{"a": a, "b": b} for a, b in merged], [{"a": a, "b": b} for a, b in passages], len(raw) - len(kept), hashlib.sha256(kept).hexdigest()
            for c, v in zip(out, row, strict=True):
                c.append(v)
        spans = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        kinds = [pa.binary(), spans, spans, pa.int64(), pa.string()]
        names = ["tid", "spans", "passages", "n_removed", "kept_sha256"]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=names)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _of_words(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of the whole words in ranges of word codes."""
    if not spans:
        return []
    starts, ends, _ = word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return [(int(starts[-(-a // CODE)]), int(ends[b // CODE - 1])) for a, b in merge_spans(spans)]


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return b"".join(kept)


# -- jobs --------------------------------------------------------------------------------------------


def _sha(text):
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def repeated_in_texts(docs: DataFrame, text_col: str = "text", width: int = 400, group_rows: int = GROUP_ROWS, gram: int = GRAM, words: int | None = None) -> DataFrame:
    """(tid, spans, passages, n_removed, kept_sha256) of the different texts with repeated bytes, copies of whole
    texts apart. ``passages``, with ``words``: the runs of so many words that occur again, whatever their length
    and the white space in them; n_removed and kept_sha256 are those of ``spans``.

    1. Texts are reduced to different ones (in the task first, then once over the cluster) and written in
       buckets, so that later joins with them do not move text.
    2. Every string picks an anchor inside it. Strings whose anchor occurs once in the corpus are unique.
    3. The bytes around the other anchors are grouped by anchor, suffixes to the right of it and prefixes
       to the left are sorted (deep-shallow), and the two orders give what is repeated. The rows of an
       anchor with over ``group_rows`` contexts are first told apart by more of their bytes.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table, path = f"texts_{uuid.uuid4().hex}", new_folder(spark)
    least = min(width, 2 * words - 1) if words else width
    texts = docs.where(F.octet_length(F.col(text_col)) >= least).select(F.unhex(F.substring(_sha(F.col(text_col)), 1, 32)).alias("tid"), F.col(text_col).alias("text"))
    texts = texts.mapInArrow(_distinct, texts.schema).repartition(parts, "tid").mapInArrow(_distinct, texts.schema)
    texts.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, "tid").saveAsTable(table)
    texts = spark.table(table)

    spans = _spans_in(texts, width, gram, group_rows, parts).withColumn("words", F.lit(False))
    if words:
        spans = spans.unionByName(_spans_in(texts, words * CODE, GRAM, group_rows, parts, words=True).withColumn("words", F.lit(True)))
    spans = spans.groupBy("tid").agg(F.collect_list(F.struct("a", "b", "words")).alias("spans"))
    return texts.join(spans, "tid").select("tid", "text", "spans").mapInArrow(_apply, FOUND)


def _spans_in(texts: DataFrame, width: int, gram: int, group_rows: int, parts: int, words: bool = False) -> DataFrame:
    """(tid, a, b): what strings of ``width`` bytes that occur again cover, in bytes or with ``words`` in word codes."""
    spots = materialise(texts.mapInArrow(_find_anchors(width, gram, words), "tid binary, h long, at long, lo long, hi long"))
    often = materialise(spots.groupBy("h").count().where("count > 1").select("h", (F.col("count") > group_rows).alias("hot")))
    again = spots.join(often, "h").groupBy("tid").agg(F.collect_list(F.struct("h", "at", "lo", "hi", "hot")).alias("spots"))
    contexts = texts.join(again, "tid").select("tid", "text", "spots").mapInArrow(
        _cut_contexts(width, words=words), "tid binary, h long, at long, lo long, bytes binary, n long, hot boolean, a long, b long"
    )
    contexts = materialise(contexts)
    known = contexts.where("h is null").select("tid", "a", "b")
    contexts = contexts.where("h is not null").select("tid", "h", "at", "lo", "bytes", "n", "hot")
    plain = contexts.where("not hot").drop("hot").repartition(parts, "h").sortWithinPartitions("h")
    spans = known.unionByName(plain.mapInArrow(_match(width, words), "tid binary, a long, b long"))
    if not often.where("hot").isEmpty():
        hot = contexts.where("hot")
        hot = hot.mapInArrow(_coded, hot.schema) if words else hot
        spans = spans.unionByName(_crowded_spans(hot, width, gram, group_rows, parts))
    return spans


def _all_bytes(n) -> Column:
    return F.array(F.struct(F.lit(0).cast("long").alias("a"), n.cast("long").alias("b")))


def _n_words(text) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def repeated_spans(
    docs: DataFrame, text_col: str = "text", width: int = 400, carry: list[str] | None = None, group_rows: int = GROUP_ROWS, gram: int = GRAM,
    words: int | None = None,
) -> DataFrame:
    """The rows with n_bytes, n_removed, n_spans, kept_sha256 and spans (array of byte ranges a to b, null
    for none): the bytes covered by a string of ``width`` bytes that also starts anywhere else.

    With ``words`` also passages (byte ranges of the runs of so many words that occur again, white space apart),
    n_passages and passage_bytes. They are found, not removed: such a run may be shorter than ``width``. A text
    of so many words that has copies is one passage.

    A text with copies goes entirely. A null or empty text, and one shorter than the width, loses nothing.
    Repeated rows count as copies. An empty table gives no rows; columns called like the added ones are
    replaced. ``carry``: columns to bring along, all but the text by default; the text may be among them.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *(["n_passages", "passage_bytes", "passages"] if words else [])]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in added and not (carry is None and c == text_col)]
    own = [f"c_{i}" for i in range(len(carry))]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialise(docs.select(*[F.col(c).alias(o) for c, o in zip(carry, own, strict=True)], F.octet_length(text).cast("long").alias("n_bytes"), _sha(text).alias("sha"), (_n_words(text) >= words if words else F.lit(False)).alias("wordy")))
    partial = materialise(repeated_in_texts(docs, text_col, width, group_rows, gram, words).withColumnsRenamed({"kept_sha256": "__kept", "n_removed": "__removed"}))
    copies = materialise(rows.where((F.col("n_bytes") >= width) | F.col("wordy")).groupBy("sha").count().where("count > 1").select("sha", F.lit(True).alias("__copy")))
    out = rows.withColumn("tid", F.unhex(F.substring("sha", 1, 32))).join(partial, "tid", "left").join(copies, "sha", "left")
    copied = F.coalesce(F.col("__copy"), F.lit(False))
    whole = copied & (F.col("n_bytes") >= width)
    spans = F.when(whole, _all_bytes(F.col("n_bytes"))).when(F.size("spans") > 0, F.col("spans"))
    passages = F.when(copied & F.col("wordy"), _all_bytes(F.col("n_bytes"))).when(F.size("passages") > 0, F.col("passages"))
    total = F.aggregate(passages, F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return out.select(
        *[F.col(o).alias(c) for c, o in zip(carry, own, strict=True)], "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("__removed", F.lit(0))).cast("long").alias("n_removed"),
        F.coalesce(F.size(spans), F.lit(0)).cast("long").alias("n_spans"),
        F.when(whole, F.lit(EMPTY_SHA)).otherwise(F.coalesce("__kept", "sha")).alias("kept_sha256"),
        spans.alias("spans"),
        *([F.coalesce(F.size(passages), F.lit(0)).cast("long").alias("n_passages"), F.coalesce(total, F.lit(0)).cast("long").alias("passage_bytes"), passages.alias("passages")] if words else []),
    )


def remove_repeats(docs: DataFrame, text_col: str = "text", width: int = 400, words: int | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The documents with the repeated bytes taken out of their texts, and with ``words`` the runs of so many words.

    Every row stays, if need be with an empty text; a null text stays null. A character that a cut goes
    through goes as a whole.
    """
    names, at = docs.columns, docs.columns.index(text_col)
    own = docs.withColumn("__sha", _sha(F.col(text_col)))
    partial = materialise(repeated_in_texts(docs, text_col, width, group_rows, words=words).select("tid", F.concat("spans", "passages").alias("spans")))
    size = F.octet_length(F.col(text_col))
    long = size >= width
    if words:
        long = long | (_n_words(F.col(text_col)) >= words)
    copies = own.where(long).groupBy("__sha", size.cast("long").alias("n")).count().where("count > 1")
    copies = copies.select(F.unhex(F.substring("__sha", 1, 32)).alias("tid"), _all_bytes(F.col("n")).alias("all"))
    spans = materialise(partial.join(copies, "tid", "full").select(F.col("tid").alias("__tid"), F.coalesce("all", "spans").alias("__spans")))
    found = own.withColumn("__t", F.unhex(F.substring("__sha", 1, 32))).join(spans, F.col("__t") == F.col("__tid"), "left")

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(names)).to_pylist()
            texts = [
                t if not own or t is None else cut(t.encode(), merge_spans([(x["a"], x["b"]) for x in own])).decode(errors="ignore")
                for t, own in zip(batch.column(at).to_pylist(), spans, strict=True)
            ]
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return found.select(*names, "__spans").mapInArrow(run, docs.schema)
