"""Collocated phrases counted by prefix-free parsing (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from savorgrid.session import materialise

from .textcore import LOWER, PrefixHash, chunks, freeing, mix

TRIGGER = 32  # one window of words in so many ends a chunk
LONGEST = 512  # words of a chunk at most, besides the overlap
BITS = 24  # of the maps that say which shorter phrases are frequent: 2 MB each, however large the corpus
BATCH = 4 << 20  # bytes of chunks counted at once
PARSED = 1 << 20  # bytes of texts parsed at once; the working arrays take up to a hundred times as many
SALTS = 16  # parts over which the phrases that share a first or last part are spread

STOPS = b".,;:!?\n\x0b\x0c\r"
_STEP = np.uint64(0xD1B54A32D192ED03)
_KIND = np.zeros(256, dtype=np.uint8)  # 0 word, 1 blank, 2 end of a piece
_KIND[list(b" \t")] = 1
_KIND[list(STOPS)] = 2


def tokens_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the tokens of a buffer: words, and one empty token for each run of piece ends."""
    kind = _KIND[buf]
    first = np.zeros(len(buf), dtype=bool)
    first[off[:-1][off[:-1] < len(buf)]] = True
    word = kind == 0
    starts = np.flatnonzero(word & (first | np.concatenate([[True], ~word[:-1]])))
    ends = np.flatnonzero(word & np.concatenate([first[1:] | ~word[1:], [True]])) + 1
    stops = np.flatnonzero(kind == 2)
    # of the stops between two words the first counts
    gap = np.searchsorted(starts, stops) + np.searchsorted(off, stops, "right")
    stops = stops[np.concatenate([[True], gap[1:] != gap[:-1]])] if len(stops) else stops
    at = np.concatenate([starts, stops])
    to = np.concatenate([ends, stops])
    order = np.argsort(at, kind="stable")
    at, to = at[order], to[order]
    return at, to, np.searchsorted(off, at, "right") - 1


def _parse(overlap: int):
    """Chunks of every text: (lang, chunk, owned). A chunk ends ``overlap`` words after the place where the
    next one begins; phrases that begin among its first ``owned`` tokens are its own."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, buf, off in chunks(batch.column(1), PARSED):
                buf = LOWER[buf]
                at, to, row = tokens_of(buf, off)
                n = len(at)
                if not n:
                    continue
                words = PrefixHash(buf).spans(at, to)
                # a buffer of the tokens, each followed by one blank; a stop is written as a full stop
                size = np.maximum(to - at, 1)
                place = np.concatenate([[0], np.cumsum(size + 1)])
                flat = np.full(place[-1], 0x20, dtype=np.uint8)
                inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                flat[np.repeat(place[:-1], size) + inside] = np.where(np.repeat(to == at, size), 0x2E, buf[np.repeat(at, size) + inside])
                flat = flat.tobytes()
                end_of = np.searchsorted(row, np.arange(last - first), "right")[row]  # end of the token's text
                window = np.zeros(n, dtype=np.uint64)
                for k in range(overlap):
                    window = window * _STEP + words[np.minimum(np.arange(n) + k, n - 1)]
                begins = np.concatenate([[True], row[1:] != row[:-1]])
                begins |= (mix(window) % np.uint64(TRIGGER) == 0) & (np.arange(n) + overlap < end_of)
                cut = np.flatnonzero(begins)
                gap = np.diff(np.concatenate([cut, [n]]))
                more = (gap - 1) // LONGEST
                cut = np.repeat(cut, more + 1)
                cut = cut + LONGEST * (np.arange(len(cut)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1))
                until = np.minimum(np.concatenate([cut[1:], [n]]), end_of[cut])
                lasts = np.minimum(until + overlap, end_of[cut])
                texts = [flat[a:b] for a, b in zip(place[cut].tolist(), (place[lasts] - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row[cut] + first)), pa.array(texts, pa.binary()).view(pa.string()), pa.array((until - cut).astype(np.int32))],
                    names=["lang", "chunk", "owned"],
                )

    return run


class _Chunks:
    """Chunks of some rows as arrays: a row for each token."""

    def __init__(self, lang: pa.Array, chunk: pa.Array, owned: np.ndarray, freq: np.ndarray):
        raw = chunk.cast(pa.large_binary())
        _, offsets, data = raw.buffers()
        off = np.frombuffer(offsets, dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
        self.bytes = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        blank = self.bytes == 0x20
        self.starts = np.sort(np.concatenate([off[:-1], np.flatnonzero(blank) + 1]))
        self.ends = np.sort(np.concatenate([off[1:], np.flatnonzero(blank)]))
        row = np.searchsorted(off, self.starts, "right") - 1
        n = np.diff(np.searchsorted(row, np.arange(len(off))))
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        self.stop = (self.ends - self.starts == 1) & (self.bytes[self.starts] == 0x2E)
        self.words = PrefixHash(self.bytes).spans(self.starts, self.ends)
        self.row, self.own, self.freq = row, (place < owned[row]) & ~self.stop, freq[row]
        codes = lang.dictionary_encode()
        self.langs = codes.dictionary
        self.lang_of = codes.indices.to_numpy()
        names = [np.frombuffer(x.encode(), dtype=np.uint8) for x in self.langs.to_pylist()]
        self.lang_hash = np.array([PrefixHash(x).spans(np.array([0]), np.array([len(x)]))[0] for x in names], dtype=np.uint64)[self.lang_of][row]

    def phrases(self, width: int, maps: list[np.ndarray], own: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """First tokens and hashes of the phrases of ``width`` words; only those whose parts are in the maps
        of the shorter widths. ``own``: those that this chunk counts."""
        n = len(self.words) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        ok = (self.own[:n] if own else ~self.stop[:n]) & (self.row[:n] == self.row[width - 1 :])
        for k in range(1, width):
            ok = ok & ~self.stop[k : k + n]
        at = np.flatnonzero(ok)
        for part in range(1, width):
            if part <= len(maps):
                for shift in range(width - part + 1):
                    at = at[_in(maps[part - 1], self._hash(at + shift, part))]
        return at, self._hash(at, width)

    def _hash(self, at: np.ndarray, width: int) -> np.ndarray:
        out = self.lang_hash[at] + np.uint64(width)
        for k in range(width):
            out = out * _STEP + self.words[at + k]
        return mix(out)

    def texts(self, at: np.ndarray, width: int) -> pa.Array:
        raw = self.bytes.tobytes()
        return pa.array([raw[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at + width - 1].tolist(), strict=True)], pa.binary()).view(pa.string())


def _in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _weighted(hashes: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first of each hash, and the sum of its weights."""
    order = np.argsort(hashes, kind="stable")
    sorted_ = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(order) else np.zeros(0, np.int64)
    return order[first], np.add.reduceat(freq[order], first) if len(first) else np.zeros(0, np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunks]:
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(1).nbytes
        if size >= BATCH:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> _Chunks:
    lang, chunk, owned, freq = pa.Table.from_batches(held).combine_chunks().columns
    one = lambda c: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    return _Chunks(one(lang), one(chunk), owned.to_numpy(), freq.to_numpy())


def _count_hashes(width: int, maps):
    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            at, hashes = block.phrases(width, maps.value)
            which, count = _weighted(hashes, block.freq[at])
            yield pa.RecordBatch.from_arrays([pa.array(hashes[which].view(np.int64)), pa.array(count)], names=["h", "n"])

    return run


def _count_texts(widths: range, maps):
    """Phrases by text; with maps only those that are in the map of their width."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            for width in widths:
                at, hashes = block.phrases(width, maps.value[: width - 1])
                if len(maps.value) >= width:
                    known = _in(maps.value[width - 1], hashes)
                    at, hashes = at[known], hashes[known]
                which, count = _weighted(hashes, block.freq[at])
                at = at[which]
                yield pa.RecordBatch.from_arrays(
                    [block.langs.take(pa.array(block.lang_of[block.row[at]])), block.texts(at, width), pa.array(np.full(len(at), width, np.int32)), pa.array(count)],
                    names=["lang", "phrase", "width", "n"],
                )

    return run


@freeing
def _word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            ones = np.ones(batch.num_rows, dtype=np.int64)
            block = _Chunks(batch.column(0), batch.column(1), ones, ones)
            yield pa.RecordBatch.from_arrays([pa.array(block.phrases(1, [])[1].view(np.int64))], names=["h"])


def _bit_map(hashes: DataFrame) -> np.ndarray:
    """2**BITS bits: those at the first BITS bits of the hashes ``h``. Of fixed size, so the driver can hold it."""
    place = F.shiftrightunsigned("h", 64 - BITS) + 1
    parts = hashes.groupBy(F.call_function("bitmap_bucket_number", place).alias("bucket")).agg(
        F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", place)).alias("bits")
    )
    out = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    for r in parts.toLocalIterator():
        some = np.frombuffer(r.bits, dtype=np.uint8)
        out[(r.bucket - 1) * len(some) : r.bucket * len(some)] = some
    return out


def parse(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", overlap: int = 4) -> DataFrame:
    """The dictionary of a prefix-free parse: (lang, chunk, owned) with ``freq``, how often it occurs.

    Lower-cased words, a full stop for the end of a piece. A chunk begins at a text's start and where the
    hash of the next ``overlap`` tokens says so, whatever comes before, so equal passages fall into equal
    chunks; after LONGEST tokens without such a place one begins anyway.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_parse(overlap), "lang string, chunk string, owned int").groupBy("lang", "chunk", "owned").agg(F.count("*").alias("freq"))


def frequent_phrases(dictionary: DataFrame, min_count: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, width, n) of every phrase of 1 to ``longest`` words that occurs ``min_count`` times, and
    (lang, n) with the words of each language. Both are counted exactly, by text.

    A phrase is as rare as its rarest part, so widths are counted one after the other: hashes of the phrases
    whose shorter parts are frequent are summed, and those that reach ``min_count`` are entered in a bit map
    of fixed size for the next width. Equal hashes only add, so a map lets rare phrases through at worst.
    The last pass counts what is left by its text.
    """
    sc = dictionary.sparkSession.sparkContext
    words = materialise(dictionary.mapInArrow(_count_texts(range(1, 2), sc.broadcast([])), "lang string, phrase string, width int, n long").groupBy("lang", "phrase", "width").agg(F.sum("n").alias("n")))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    words = words.where(F.col("n") >= min_count)
    maps = [_bit_map(words.select("lang", "phrase").mapInArrow(_word_hashes, "h long"))]
    for width in range(2, longest + 1):
        sums = dictionary.mapInArrow(_count_hashes(width, sc.broadcast(maps)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        maps.append(_bit_map(sums.where(F.col("n") >= min_count).select("h")))
    texts = dictionary.mapInArrow(_count_texts(range(2, longest + 1), sc.broadcast(maps)), "lang string, phrase string, width int, n long")
    texts = texts.groupBy("lang", "phrase", "width").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    return materialise(texts.unionByName(words)), totals


def _part(first: Column, last: Column) -> Column:
    """Words ``first`` to ``last`` (from 1) of the array column ``words`` as text."""
    return F.array_join(F.slice("words", first, last - first + 1), " ")


def cohesion(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)), by decimals of 38 digits."""
    wide = [c.cast("decimal(19,0)") for c in (a, n, left, right)]
    return F.call_function("div", (F.lit(1000).cast("decimal(4,0)") * wide[0] * wide[1]).cast("decimal(38,0)"), (wide[2] * wide[3]).cast("decimal(38,0)"))


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 100, longest: int = 5, top: int = 2000,
) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and pieces into words at
    blanks and tabs. n counts a language's words, f(phrase) its contiguous occurrences within pieces. A
    phrase with a = f(phrase) >= ``min_count`` is a candidate; cut after its first k words into parts that
    occur l and r times it has the score floor(1000 a n / (l r)); the lowest of its cuts counts, the
    smallest k among equals. A candidate that lies inside a longer candidate as frequent as it is dropped.
    Order: score and a descending, then the phrase in byte order.

    Counting works on the dictionary of a prefix-free parse, so passages that are copied a thousand times
    are counted once, with their frequency; phrases in the overlap of two chunks belong to the first.
    A null language is ``und``; null or empty texts have no words; repeated rows count each; an empty table
    gives no rows; other columns are not read. a and n may be up to 19 digits, 1000 a n up to 38.
    """
    dictionary = materialise(parse(docs, text_col, lang_col, overlap=longest - 1))
    frequent, totals = frequent_phrases(dictionary, min_count, longest)
    candidates = frequent.where("width > 1").withColumn("words", F.split("phrase", " "))

    # the longest phrase as frequent as the candidate that holds it; one sum for each part, made in the tasks first
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("width") - 1), lambda w: F.transform(F.sequence(F.lit(1), F.col("width") - w + 1), lambda i: _part(i, i + w - 1))))
    inside = candidates.where("width > 2").select("lang", F.explode(spans).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("within"))
    candidates = candidates.join(inside, ["lang", "phrase"], "left").where("within is null or within < n").drop("within")

    # parts and totals are written SALTS times, so that a word that begins a third of all phrases is met in SALTS places
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    parts, of_lang = frequent.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"), salt), totals.select("lang", F.col("n").alias("n"), salt)
    cuts = candidates.select(
        "lang", "phrase", F.col("n").alias("a"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int").alias("salt"), "words", "width",
        F.explode(F.sequence(F.lit(1), F.col("width") - 1)).alias("k"),
    )
    cuts = cuts.select("lang", "phrase", "a", "salt", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("width")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.withColumnsRenamed({"part": side, "f": name}), ["lang", side, "salt"])
    cuts = cuts.join(of_lang, ["lang", "salt"]).withColumn("score", cohesion(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")

    # first within parts of a language, so that no task sorts all phrases of one
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    spread = F.pmod(F.xxhash64("phrase", F.lit(1)), F.lit(max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)))
    scored = scored.withColumn("part", spread).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    scored = scored.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return scored.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
