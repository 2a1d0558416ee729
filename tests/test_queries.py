"""The registry, and a sample of registered queries against their check SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "p02_structured_hours", "p08_cover_grid", "f12_open_on_day", "u06_attempt_status", "j02_nearest_district",
    "j12_match_place", "a04_hex_table", "a14_reviewer_quality", "a17_validation_report", "m07_expected_by_groups",
    "q04_district_stats", "t02_rolling_views",
]


def test_registry_is_complete():
    keys = entry.queries().keys()
    wanted = {"s": 8, "p": 11, "f": 14, "j": 22, "a": 19, "w": 9, "u": 7, "x": 22, "c": 25, "m": 7, "q": 10, "t": 3}
    for letter, n in wanted.items():
        have = {k[:3] for k in keys if k[0] == letter and k[1:3].isdigit()}
        assert have == {f"{letter}{i:02d}" for i in range(1, n + 1)}
    assert set(entry.oracle_sql()) <= set(keys)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = entry.queries()[name](spark, SF)
    rel = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, rel.fetchall())
