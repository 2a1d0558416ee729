"""How far sources diverge in their vocabulary: a translate-table tokenizer with sparse counts (operator 13)."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from savorgrid.session import materialise

SCALE = 1_000_000_000
ENTRIES = 1_000_000  # counted terms that a task holds before it hands them on
PAIR_ROWS = 400_000  # rows of terms of several sources that a task compares at once

#: ASCII letters in lower case, all bytes beyond ASCII as they are, every other byte a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

COUNTED = "lang string, source string, term string, n long, docs long"


def terms_of(text: bytes) -> Counter:
    """Terms of one document and how often it has them."""
    return Counter(text.translate(LETTERS).split())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term) of a task; handed on whenever many are held."""
    n: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for group, counts in n.items():
            k = len(counts)
            if k:
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.DictionaryArray.from_arrays(pa.array(np.zeros(k, np.int32)), pa.array([x])).dictionary_decode() for x in group],
                        pa.array(list(counts), pa.binary()).view(pa.string()), pa.array(list(counts.values()), pa.int64()),
                        pa.array([docs[group][t] for t in counts], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )
        n.clear()
        docs.clear()

    held = 0
    for batch in batches:
        langs, sources = (batch.column(i).to_pylist() for i in (0, 1))
        for lang, source, text in zip(langs, sources, batch.column(2).cast(pa.large_binary()), strict=True):
            seen = terms_of(text.as_py())
            mine = n[lang, source]
            before = len(mine)
            for term, k in seen.items():
                mine[term] += k
            docs[lang, source].update(seen.keys())
            held += len(mine) - before
            if held > ENTRIES:
                yield from flush()
                held = 0
    yield from flush()


def share(n: Column, total: Column) -> Column:
    """1 + floor(10^9 (n + 1) / total), exact; decimals where a product could pass 64 bits."""
    small = F.lit(SCALE).cast("long") * (n + 1)
    exact = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n.cast("decimal(19,0)") + 1), total.cast("decimal(20,0)"))
    return F.when(n < (1 << 63) // SCALE - 1, F.call_function("div", small, total)).otherwise(exact).cast("long") + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most 10^9 + 1, so squares fit in 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every two groups, summed over the terms that both have: what their gap is beyond the gaps in which
    one of them or both lack the term. Rows (term id, group, p, share of a term that the group lacks) come
    sorted by term and group; neighbours at distance 1, 2, ... are compared while they share a term."""
    held: list[np.ndarray] | None = None

    def sums(term, group, p, p0):
        names, at = np.unique(group, return_inverse=True)
        keys, values = [], []
        live, d = np.arange(len(term)), 1
        while True:
            live = live[live + d < len(term)]
            live = live[term[live] == term[live + d]]
            if not len(live):
                break
            a, b = live, live + d
            for x, y in ((a, b), (b, a)):
                key = at[x] * len(names) + at[y]
                value = _gap(p[x], p[y]) - _gap(p[x], p0[y]) - _gap(p0[x], p[y]) + _gap(p0[x], p0[y])
                order = np.argsort(key, kind="stable")
                key, value = key[order], value[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                keys.append(key[first])
                values.append(np.add.reduceat(value, first))
            d += 1
        if not keys:
            return None
        key, value = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key = key[first]
        return pa.RecordBatch.from_arrays(
            [pa.array(names[key // len(names)]), pa.array(names[key % len(names)]), pa.array(np.add.reduceat(value, first))], names=["g", "o", "value"]
        )

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if len(held[0]) >= PAIR_ROWS:
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last and (out := sums(*[c[:last] for c in held])) is not None:
                yield out
            held = [c[last:] for c in held]
    if held is not None and len(held[0]) and (out := sums(*held)) is not None:
        yield out


def source_audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, top: int = 200,
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) that say how a source's words differ.

    Terms are runs of ASCII letters and of characters beyond ASCII, with A-Z in lower case. A language keeps
    the V terms in at least ``min_docs`` of its documents. A group (lang, source), and each language, gives
    a kept term the share p = 1 + floor(10^9 (n + 1) / (N + V)): n its occurrences there, N those of all kept
    terms. The gap of p from q is floor((p - q)^2 / q). Part ``pair``: every other source of the language,
    the gaps from it summed over all kept terms, largest first. Part ``term``: the group's terms with a
    larger share than the language gives them, by gap, the first ``top``. Ties go by item.

    Each task counts its documents one by one and adds up sparse rows (group, term); one exchange by
    (lang, term) makes a table with a row for each kept term, which lists the sources that have it. Shares
    need only a group's N and V. The sum over all V terms is put together from three parts, none of which
    touches terms that both sources lack: what it would be if both lacked every term, a correction for the
    terms that one has, from the histogram of a group's counts, and one for the terms that both have.

    Null text, lang and source count as ''. A group without terms has pairs but no term rows; with V = 0 its
    pairs are 0. Repeated rows count each, rows are documents whatever their ids; an empty table gives no
    rows. Sums of gaps must fit in 64 bits, as ``value`` does.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = rows.mapInArrow(_counts, COUNTED).repartition("lang", "term")
    by_source = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = by_source.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("sources"),
    )
    kept = materialise(kept.where(F.col("docs") >= min_docs).drop("docs"))  # a list has one entry for a source at most

    each = kept.select("lang", "term", "total", F.explode("sources").alias("s")).select("lang", "term", "total", "s.source", "s.n")
    histogram = materialise(each.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    sizes = histogram.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("n_group"))
    groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.select(
        "lang", "source", F.coalesce("v", F.lit(0)).cast("long").alias("v"), (F.coalesce("n_group", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("of_group"),
        (F.coalesce("n_lang", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("of_lang"),
    )
    lacking = F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("of_group")))
    groups = materialise(groups.withColumn("p0", lacking).withColumn("g", F.monotonically_increasing_id()))

    known = groups.select("lang", "source", "of_group", "of_lang", "p0", "g")
    terms = each.join(known, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("of_group")).alias("p"), share(F.col("total"), F.col("of_lang")).alias("q"),
    )
    terms = terms.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = terms.withColumn("rank", place).where(F.col("rank") <= top)

    return terms.unionByName(_pairs(kept, histogram, groups).withColumn("rank", place)).select("lang", "source", "part", "item", "value", "rank")


def _pairs(kept: DataFrame, histogram: DataFrame, groups: DataFrame) -> DataFrame:
    known = groups.select("lang", "source", "of_group", "p0", "g")
    other = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("o"), F.col("p0").alias("q0"))
    exact = "decimal(38,0)"

    # terms that one group has, as if the other lacked them: both as group and as item
    one = histogram.join(known, ["lang", "source"]).select("lang", "g", "p0", "terms", share(F.col("n"), F.col("of_group")).alias("p"))
    one = one.join(other, "lang").where("g != o")
    one = one.groupBy("g", "o").agg(
        F.sum((F.col("terms").cast(exact) * (gap(F.col("p"), F.col("q0")) - gap(F.col("p0"), F.col("q0"))).cast("decimal(19,0)")).cast(exact)).alias("to"),
        F.sum((F.col("terms").cast(exact) * (gap(F.col("q0"), F.col("p")) - gap(F.col("q0"), F.col("p0"))).cast("decimal(19,0)")).cast(exact)).alias("from"),
    )
    one = materialise(one)

    # terms that both have; the row of a kept term is named by its place in the written table
    several = kept.where(F.size("sources") > 1).withColumn("term_id", F.monotonically_increasing_id())
    several = several.select("lang", "term_id", F.explode("sources").alias("s")).select("lang", "term_id", "s.source", "s.n").join(known, ["lang", "source"])
    several = several.select("term_id", "g", share(F.col("n"), F.col("of_group")).alias("p"), "p0")
    both = several.repartition("term_id").sortWithinPartitions("term_id", "g").mapInArrow(_shared, "g long, o long, value long")

    sums = one.select("g", "o", F.col("to").alias("value")).unionByName(one.select(F.col("o").alias("g"), F.col("g").alias("o"), F.col("from").alias("value")))
    sums = sums.unionByName(both.withColumn("value", F.col("value").cast(exact))).groupBy("g", "o").agg(F.sum("value").alias("sum"))
    none = F.when(F.col("v") > 0, F.col("v").cast(exact) * gap(F.col("p0"), F.col("q0")).cast("decimal(19,0)"))
    pairs = groups.join(other, "lang").where("g != o").select("lang", "source", "item", "g", "o", none.cast(exact).alias("none"))
    value = (F.coalesce("none", F.lit(0).cast(exact)) + F.coalesce("sum", F.lit(0).cast(exact))).cast("long")
    return pairs.join(sums, ["g", "o"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
