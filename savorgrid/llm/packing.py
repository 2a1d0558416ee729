"""Best-fit packing by a linear grouping scheme (operator 5)."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from savorgrid.session import materialise

from .textcore import LOWER, PrefixHash, chunks, freeing, word_spans

_TOKENIZERS: dict = {}


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    if path not in _TOKENIZERS:
        whole, bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # a word of a-z alone passes both of these unchanged and in one piece
        bare.normalizer = None
        bare.pre_tokenizer = None
        _TOKENIZERS[path] = whole, bare
    return _TOKENIZERS[path]


def _forget_tokenizers() -> None:
    """Two of them and their caches are tens of MB in every worker that lives on and waits for other maps."""
    _TOKENIZERS.clear()


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True


def _occurrences(low: np.ndarray, off: np.ndarray, added: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the added tokens in the texts, in any case and overlapping ones too."""
    raw, begin, end = low.tobytes(), [], []
    for token in added:
        at = raw.find(token)
        while at >= 0:
            begin.append(at)
            end.append(at + len(token))
            at = raw.find(token, at + 1)
    begin, end = np.array(begin, dtype=np.int64), np.array(end, dtype=np.int64)
    within = np.searchsorted(off, begin, "right") == np.searchsorted(off, end, "left")
    return begin[within], end[within]


def _parts(buf: np.ndarray, off: np.ndarray, added: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and starts, ends and first part of each text for words cut where punctuation
    follows an ASCII letter: the tokenizer's pieces never cross such a place or white space, but for its
    ``added`` tokens (lower-cased here), in which nothing is cut or lower-cased.

    A capital before a non-ASCII byte stays, as a combining mark may join it.
    """
    starts, ends, word_at = word_spans(buf, off)
    if not len(starts):
        return buf, starts, ends, word_at
    cut = np.flatnonzero(_LETTER[buf[:-1]] & _PUNCT[buf[1:]]) + 1
    cut = cut[~np.isin(cut, off)] if len(cut) else cut
    low = LOWER[buf]
    before_wide = np.flatnonzero(buf[1:] >= 0x80)
    low[before_wide] = buf[before_wide]
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    begin, end = _occurrences(LOWER[buf], off, added)
    if len(begin):
        change = np.zeros(len(buf) + 1, dtype=np.int32)
        np.add.at(change, begin, 1)
        np.add.at(change, end, -1)
        inside = np.cumsum(change[:-1]) > 0
        low[inside] = buf[inside]
        change[:] = 0
        np.add.at(change, begin + 1, 1)
        np.add.at(change, end, -1)
        between = np.cumsum(change) > 0  # a cut here would be within a token
        starts, ends = starts[~between[starts]], ends[~between[ends]]
    return low, starts, ends, np.searchsorted(starts, off)


class WordTable:
    """Ids of the words a task has met, by word hash; started anew when it holds ``limit`` words."""

    def __init__(self, path: str, limit: int = 1_500_000):
        self.whole, self.bare = (getattr(t, "encode_batch_fast", t.encode_batch) for t in _tokenizer(path))
        tokens = _tokenizer(path)[0].get_added_tokens_decoder().values()
        self.added = sorted({LOWER[np.frombuffer(x, np.uint8)].tobytes() for t in tokens if (x := t.content.strip().encode())})
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.begin = self.size = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def learn(self, keys: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> None:
        """Encode the words of sorted ``keys`` that are new; ``plain`` ones are letters a to z alone."""
        if len(self.keys) + len(keys) > self.limit:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), dtype=bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        begin, size, flat = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64), [self.ids]
        total = len(self.ids)
        for encode, own in ((self.bare, np.flatnonzero(new & plain)), (self.whole, np.flatnonzero(new & ~plain))):
            for k in range(0, len(own), 20_000):
                some = own[k : k + 20_000]
                words = [raw[s:e].decode() for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
                found = [e.ids for e in encode(words, add_special_tokens=False)]
                size[some] = n = np.array([len(x) for x in found], dtype=np.int64)
                begin[some] = total + np.cumsum(n) - n
                flat.append(np.array(list(chain.from_iterable(found)), dtype=np.uint32))
                total += len(flat[-1])
        keys = np.concatenate([self.keys, keys[new]])
        order = np.argsort(keys, kind="stable")
        self.keys, self.ids = keys[order], np.concatenate(flat)
        self.begin = np.concatenate([self.begin, begin[new]])[order]
        self.size = np.concatenate([self.size, size[new]])[order]


def token_ids(column: pa.Array, table: WordTable, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, all ids, where each text's ids start) for runs of texts; every text ends with ``end_id``.

    For tokenizers that never look across white space: each different word is encoded once.
    """
    for first, last, buf, off in chunks(column, 2 << 20):
        buf, starts, ends, word_at = _parts(buf, off, table.added)
        hashes = np.concatenate([PrefixHash(b).spans(s, e) for b, s, e in _slices(buf, starts, ends)] or [np.zeros(0, np.uint64)])
        keys, where, of_word = np.unique(hashes, return_index=True, return_inverse=True)
        other = np.concatenate([[0], np.cumsum(~(_LETTER[buf] & (buf >= 97)), dtype=np.int32)]) if len(buf) else np.zeros(1, np.int32)
        plain = other[ends[where]] == other[starts[where]]
        table.learn(keys, buf.tobytes(), starts[where], ends[where], plain)
        at = np.searchsorted(table.keys, keys)
        sizes, begin = table.size[at], table.begin[at]
        # texts of some hundred thousand words at a time, to bound the working arrays
        i = 0
        while i < last - first:
            j = min(last - first, max(i + 1, int(np.searchsorted(word_at, word_at[i] + 500_000, "right")) - 1))
            of = of_word[word_at[i] : word_at[j]]
            n = sizes[of]
            upto = np.concatenate([[0], np.cumsum(n)])
            flat = table.ids[np.arange(upto[-1]) + np.repeat(begin[of] - upto[:-1], n)]
            bounds = upto[word_at[i : j + 1] - word_at[i]]
            flat = np.insert(flat, bounds[1:], end_id).astype("<u4")
            yield first + i, flat, bounds + np.arange(len(bounds))
            i = j


def _slices(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: int = 500_000):
    """Stretches of a buffer with their own words, so that 8-byte arrays over bytes stay small."""
    for k in range(0, len(starts), words):
        s, e = starts[k : k + words], ends[k : k + words]
        yield buf[s[0] : e[-1]], s - s[0], e - s[0]


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Every document's ids, cut every ``capacity`` ids: the other columns, piece, start, length, ids
    (little-endian uint32), ids_crc32; __part and __nth number the pieces of one length within a task."""
    rest = [c for c in docs.columns if c != text_col]
    docs = docs.select(*rest, F.col(text_col).alias("__text"))
    added = [
        StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()),
        StructField("ids", BinaryType()), StructField("ids_crc32", LongType()), StructField("__part", IntegerType()), StructField("__nth", LongType()),
    ]

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, table = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64), WordTable(tokenizer_path)
        for batch in batches:
            for first, flat, bounds in token_ids(batch.column(len(rest)), table, end_id):
                total = np.diff(bounds)
                count = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), count)
                piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, total[row] - start)
                begin = bounds[row] + start
                nth = np.zeros(len(row), dtype=np.int64)
                for i, n in enumerate(length.tolist()):
                    nth[i] = seen[n]
                    seen[n] += 1
                blobs = [flat[b : b + n].tobytes() for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.take(pa.array(first + row)) for c in batch.columns[: len(rest)]],
                        pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(blobs, pa.binary()),
                        pa.array([zlib.crc32(b) for b in blobs], pa.int64()), pa.array(np.full(len(row), part, dtype=np.int32)), pa.array(nth),
                    ],
                    names=[*rest, *[f.name for f in added]],
                )
        _forget_tokenizers()

    return docs.mapInArrow(run, StructType([*docs.drop("__text").schema.fields, *added]))


def _best_pattern(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity of greatest value (unbounded knapsack)."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.array(sizes)
    for c in range(int(order.min()), capacity + 1):
        fits = np.flatnonzero(order <= c)
        gain = best[c - order[fits]] + values[fits]
        k = int(gain.argmax())
        best[c], pick[c] = best[c - 1], -1
        if gain[k] > best[c] + 1e-12:
            best[c], pick[c] = gain[k], fits[k]
    pattern, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[capacity]), pattern


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often to use each: the cutting-stock linear program, by column generation."""
    m = len(sizes)
    columns = [np.eye(m, dtype=np.int64)[i] * (capacity // sizes[i]) for i in range(m)]
    b = np.array(demand, dtype=float)
    basis = np.stack(columns, axis=1).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        x = inverse @ b
        prices = inverse.sum(axis=0)
        value, pattern = _best_pattern(sizes, np.maximum(prices, 0.0), capacity)
        if value <= 1 + 1e-9:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-12, x / np.where(step > 1e-12, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = pattern
    x = np.linalg.solve(basis, b)
    return [(basis[:, i].astype(np.int64), float(x[i])) for i in range(m) if x[i] > 1e-9]


def packing_plan(histogram: dict[int, int], capacity: int, groups: int = 40, small: tuple[float, ...] = (0.3, 0.4, 0.5)) -> list[tuple[int, int, int, int, int]]:
    """The plan with the fewest sequences of those that take lengths over each share ``small`` as large."""
    plans = [_plan(histogram, capacity, groups, s) for s in small]
    return min(plans, key=lambda p: max((at + n for _, _, n, at, _ in p), default=0))


def _plan(histogram: dict[int, int], capacity: int, groups: int, small: float) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset): the pieces of a length with ranks from the first
    on go to consecutive sequences, all at that offset.

    Works on the histogram of lengths alone, so its size depends on the capacity, not on the corpus. Large
    lengths (over ``small`` of the capacity) are cut into groups of equal cardinality and rounded up to
    the group's largest; the linear program over those few sizes says which configurations to use; actual
    lengths are then put into the slots of their group, longest first. What is left over from rounding
    down, and all small lengths, go where they fit best, in decreasing order; then into new sequences.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    left = {n: c for n, c in histogram.items() if c}
    used: dict[int, int] = defaultdict(int)  # ranks taken of each length
    sequences = 0
    if left.get(capacity):
        plan.append((capacity, 0, left[capacity], 0, 0))
        sequences = left.pop(capacity)

    large = sorted((n for n in left if n > small * capacity), reverse=True)
    total = sum(left[n] for n in large)
    quota = -(-total // groups) if total else 0
    runs: list[list[list[int]]] = []  # of each group: [length, count], longest first
    room = 0
    for n in large:
        c = left[n]
        while c:
            if room == 0:
                runs.append([])
                room = quota
            take = min(c, room)
            runs[-1].append([n, take])
            c, room = c - take, room - take
    # groups that begin with the same length are one size
    sizes: list[int] = []
    merged: list[list[list[int]]] = []
    for run in runs:
        if sizes and sizes[-1] == run[0][0]:
            merged[-1].extend(run)
        else:
            sizes.append(run[0][0])
            merged.append(run)
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> ranges of sequences
    if sizes:
        demand = [sum(c for _, c in run) for run in merged]
        for pattern, times in configurations(sizes, demand, capacity):
            n = int(times + 1e-9)
            if not n:
                continue
            segments = [(sequences, n, 0)]
            sequences += n
            for g in np.repeat(np.arange(len(sizes)), pattern):
                out = []
                for at, count, offset in segments:
                    while count:
                        if not merged[g]:  # the group is used up: the slot stays open
                            out.append((at, count, offset))
                            break
                        length, have = merged[g][0]
                        take = min(count, have)
                        plan.append((length, used[length], take, at, offset))
                        used[length] += take
                        left[length] -= take
                        out.append((at, take, offset + length))
                        at, count = at + take, count - take
                        merged[g][0][1] -= take
                        if not merged[g][0][1]:
                            merged[g].pop(0)
                segments = out
            for at, count, offset in segments:
                free[capacity - offset].append((at, count))
    rooms = sorted(r for r in free if r)

    for length in sorted((n for n in left if left[n]), reverse=True):
        count = left[length]
        while count:
            i = bisect_left(rooms, length)
            if i == len(rooms):  # nothing fits: new sequences
                n = -(-count // (capacity // length))
                room_, at = capacity, sequences
                sequences += n
                while n:
                    take = min(n, count)
                    put_rest = n - take
                    plan.append((length, used[length], take, at, capacity - room_))
                    used[length] += take
                    count -= take
                    if put_rest:
                        _give(free, rooms, room_, at + take, put_rest)
                    n, room_ = take, room_ - length
                    if not count or room_ < length:
                        _give(free, rooms, room_, at, n)
                        break
                continue
            r = rooms[i]
            at, have = free[r].pop()
            if not free[r]:
                rooms.pop(i)
            take = min(have, count)
            if have > take:
                _give(free, rooms, r, at + take, have - take)
            plan.append((length, used[length], take, at, capacity - r))
            used[length] += take
            count -= take
            _give(free, rooms, r - length, at, take)
    return plan


def _give(free: dict[int, list[tuple[int, int]]], rooms: list[int], room: int, at: int, count: int) -> None:
    if room <= 0 or count <= 0:
        return
    if not free[room]:
        i = bisect_left(rooms, room)
        if i == len(rooms) or rooms[i] != room:
            rooms.insert(i, room)
    free[room].append((at, count))


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, text_col: str = "text", end_id: int = 0,
    groups: int = 40, carry: list[str] | None = None,
) -> DataFrame:
    """A row per piece: the other columns, piece, start, length, ids, ids_crc32, sequence_id and offset.

    Documents are tokenised once and written; only the histogram of lengths (``capacity`` numbers at most)
    reaches the driver, where the plan is made. A piece's rank among its length is its task's offset plus
    its place in the task; ranks meet the plan in a join with the broadcast plan, whose size depends on
    the capacity alone. A null or empty text has the end id only. Repeated rows are packed each; an empty
    table gives no rows; columns called like the added ones are replaced. ``carry``: columns to bring
    along besides, all but the text by default.
    """
    added = ["piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in (text_col, *added)]
    picked = docs.select(*[F.col(c).alias(f"c_{i}") for i, c in enumerate(carry)], F.col(text_col).alias("__t"))
    pieces = materialise(tokenised_pieces(picked, tokenizer_path, capacity, "__t", end_id))
    counts = pieces.groupBy("length", "__part").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("__part")) - F.col("count")
    counts = materialise(counts.select("length", "__part", "count", before.alias("__before")))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}
    plan = docs.sparkSession.createDataFrame(
        [tuple(map(int, p)) for p in packing_plan(histogram, capacity, groups)], "length long, __rank long, __n long, __at long, offset long"
    )
    ranked = pieces.join(counts.drop("count"), ["length", "__part"]).withColumn("__r", F.col("__before") + F.col("__nth"))
    plan = F.broadcast(plan)
    out = ranked.join(plan, (ranked["length"] == plan["length"]) & (ranked["__r"] >= plan["__rank"]) & (ranked["__r"] < plan["__rank"] + plan["__n"]))
    return out.select(
        *[F.col(f"c_{i}").alias(c) for i, c in enumerate(carry)], "piece", "start", ranked["length"], "ids", "ids_crc32",
        (F.col("__at") + F.col("__r") - F.col("__rank")).alias("sequence_id"), "offset",
    )
