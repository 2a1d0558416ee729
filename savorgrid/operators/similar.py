"""A similarity join of texts that loses no pair, by blocks of texts of like sizes.

The similarity is 2 M / (|a| + |b|), M the characters in common blocks, so at most those that both texts
have. Low thresholds leave no selective token to join on: most names share some of their rarest characters
or pairs of characters. So both sides are dealt into bounded blocks by size, each pair of blocks whose
sizes fit meets in one group, and a product of 0/1 matrices counts the common characters of all its pairs
at once. Blocks keep their order, so the longest common subsequence bounds M too, and closer. Only pairs
that have enough of both go on to the comparison.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import common_letters, common_sequence, ratio_column
from ..session import materialise

HOT_ROWS = 20_000  # texts with one token, or rows of one name, that are met in one place at most; more are spread over several
BLOCK = 1_000  # texts of a side that meet those of the other in one group, about

_SLACK = 1e-9
_STEP = 1.15  # sizes of a block differ by this factor at most


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows over all cores: few bytes stand for much work here, so partitions must not be merged by size."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def in_blocks(left: DataFrame, right: DataFrame, by: str, left_id: Iterable[str], right_id: Iterable[str], block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``lp`` and ``rp``: every two rows equal in ``by`` are together in one (by, lp, rp), and
    no such group has many more than ``block`` rows of a side, however many a value of ``by`` has."""
    places = lambda rows, p: rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(p))
    sizes = materialise(places(left, "lps").join(places(right, "rps"), by))

    def side(rows: DataFrame, own: str, other: str, ids: Iterable[str]) -> DataFrame:
        placed = rows.join(sizes, by).withColumn(own, F.pmod(F.xxhash64(*ids), F.col(f"{own}s")).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))).drop("lps", "rps")

    return side(left, "lp", "rp", left_id), side(right, "rp", "lp", right_id)


def _spread(tokens: DataFrame, counts: DataFrame, by: str) -> DataFrame:
    """Rows of a token that many texts have, dealt over several places by the text."""
    placed = tokens.join(counts, "token").withColumn("place", F.pmod(F.xxhash64(by), F.col("places")).cast("int"))
    return placed.drop("places", "count")


def _size_class(size: Column) -> Column:
    return F.floor(F.log(F.greatest(size, F.lit(1.0))) / float(np.log(_STEP)) + _SLACK).cast("int")


def _close_in_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a group that have enough characters in common."""
    if not len(left) or not len(right):
        return pd.DataFrame({"n": [], "m": [], "t": []}).astype({"n": str, "m": str, "t": float})
    n, m, t = left["n"].to_numpy(), right["m"].to_numpy(), left["t"].to_numpy()
    total = np.add.outer([len(x) for x in n], [len(x) for x in m])
    i, j = np.nonzero(2 * common_letters(n, m) >= (t[:, None] - _SLACK) * total)
    enough = 2 * common_sequence(n, m, i, j) >= (t[i] - _SLACK) * total[i, j]
    i, j = i[enough], j[enough]
    return pd.DataFrame({"n": n[i], "m": m[j], "t": t[i]})


def similar_texts(left: DataFrame, right: DataFrame, both: bool = False) -> DataFrame:
    """(n, m, ratio): every n of ``left`` and m of ``right`` whose similarity is at least n's ``t``. It depends
    a little on the order; ``both`` adds ``back``, that of m to n, and each is null below t.

    ``left``: different texts n with t in (0, 1]; ``right``: different texts m. Empty texts are similar to
    the empty text alone.
    """
    size = F.char_length("n")
    least, most = size * F.col("t") / (2 - F.col("t")) - _SLACK, size * (2 - F.col("t")) / F.col("t") + _SLACK
    # one class more on both sides, so that no rounding of a logarithm loses one
    classes = F.sequence(_size_class(least) - 1, _size_class(most) + 1)
    a = materialise(left.where("n <> ''").select("n", F.col("t").cast("double").alias("t"), F.explode(classes).alias("class")))
    b = materialise(right.where("m <> ''").select("m", _size_class(F.char_length("m")).alias("class")))
    a, b = in_blocks(a, b, "class", ["n"], ["m"], min(BLOCK, HOT_ROWS))
    key = ["class", "lp", "rp"]
    met = dealt(a, *key).groupBy(*key).cogroup(dealt(b, *key).groupBy(*key))
    close = met.applyInPandas(_close_in_block, "n string, m string, t double")
    empty = left.where("n = ''").select("n", "t").join(right.where("m = ''").select("m"), F.col("n") == F.col("m"))
    close = dealt(close.unionByName(empty.select("n", "m", F.col("t").cast("double").alias("t"))), "n", "m")
    ways = [ratio_column(F.col("n"), F.col("m"), F.col("t")).alias("ratio")]
    if both:
        ways.append(ratio_column(F.col("m"), F.col("n"), F.col("t")).alias("back"))
    return close.select("n", "m", *ways).where("ratio is not null or back is not null" if both else "ratio is not null")


def containing_texts(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(x, y): every x of ``inner`` that lies inside a y of ``outer``.

    A text of three characters or more is looked up by its rarest three, a shorter one by itself; the empty
    text lies in every y.
    """

    def parts(c: str, k: int) -> Column:
        return F.when(F.char_length(c) >= k, F.transform(F.sequence(F.lit(1), F.char_length(c) - k + 1), lambda i: F.substr(F.col(c), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    tokens = outer.select("y", F.explode(F.array_distinct(F.concat(parts("y", 1), parts("y", 2), parts("y", 3)))).alias("token"))
    counts = tokens.groupBy("token").count()
    counts = materialise(counts.withColumn("places", F.ceil(F.col("count") / HOT_ROWS).cast("int")))
    width = F.least(F.char_length("x"), F.lit(3))
    mine = inner.where("x <> ''").select("x", F.explode(F.array_distinct(F.when(width == 3, parts("x", 3)).otherwise(F.array("x")))).alias("token"))
    # a part that no y has rules x out: it counts as the rarest and then finds nothing
    mine = mine.join(counts, "token", "left").withColumn("_i", F.row_number().over(Window.partitionBy("x").orderBy(F.coalesce("count", F.lit(0)), "token")))
    mine = mine.where("_i = 1 and count is not null").select("x", "token", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"))
    found = mine.join(_spread(tokens, counts, "y"), ["token", "place"]).where(F.contains("y", "x")).select("x", "y")
    nothing = inner.where("x = ''").select("x", F.lit(0).alias("_k"))
    return found.unionByName(outer.select("y", F.lit(0).alias("_k")).join(nothing, "_k").select("x", "y"))
