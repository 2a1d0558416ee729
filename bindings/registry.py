"""Name -> (Spark job, check SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from savorgrid.session import new_folder, ship_package

from .tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _half_even(sql: str) -> str:
    """Write out round_even(x, n) on the decimal value, so that ties do not hang on the last bit."""
    from .sql import half_even

    start = sql.rfind("round_even(")
    while start >= 0:
        depth, at = 0, start + len("round_even")
        while True:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            if depth == 0:
                break
            at += 1
        x, places = sql[start + len("round_even(") : at].rsplit(",", 1)
        sql = sql[:start] + half_even(x, int(places)) + sql[at + 1 :]
        start = sql.rfind("round_even(", 0, start)
    return sql


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = _half_even(sql)
        return fn

    return add


def r6(c: Column | str) -> Column:
    """Rounded to six places, without negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def scratch(spark: SparkSession) -> str:
    """A new folder for a round trip."""
    return new_folder(spark)
