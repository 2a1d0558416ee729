"""Connected components as Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from savorgrid.session import materialise

from .textcore import find, unite


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A spanning forest of the links in one partition: at most one link for each node there."""
    parent: dict[int, int] = {}
    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            unite(parent, u, v)
    rows = [(x, r) for x in parent if (r := find(parent, x)) != x]
    for i in range(0, len(rows), 100_000):
        yield pd.DataFrame(rows[i : i + 100_000], columns=["u", "v"])


def forest(links: DataFrame) -> DataFrame:
    return links.mapInPandas(_forest, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u long, v long) except the roots themselves.

    Rounds of contraction: every node hooks on to its smallest neighbour, the pointers are halved until
    they reach a root, and the links are rewritten between roots. Each partition first keeps a spanning
    forest of its links, so a crowded component shrinks before it is shuffled. The joins are between
    written tables, whose hot keys adaptive execution can split. Every round is written to the shared
    folder, so that lost executors cost no more than one round. Empty links give an empty result.
    """
    links = materialise(forest(links.where("u <> v").select("u", "v")))
    out = None
    while not links.isEmpty():
        ends = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = materialise(
            ends.groupBy("u").agg(F.min("v").alias("m")).where("m < u").select(F.col("u").alias("node"), F.col("m").alias("root"))
        )
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = materialise(
                hooks.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
            )
            hooks = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        to_u = hooks.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        to_v = hooks.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        links = links.join(to_u, "u", "left").join(to_v, "v", "left")
        links = links.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")).where("u <> v")
        links = materialise(forest(links))
        if out is None:
            out = hooks
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            out = materialise(
                out.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root")).unionByName(hooks)
            )
    return out if out is not None else links.select(F.col("u").alias("node"), F.col("v").alias("root"))
