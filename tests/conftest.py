import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from savorgrid.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", "savorgrid-tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def values(spark):
    """Evaluate column builders over one column of inputs."""

    def run(inputs, ddl, build):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {ddl}")
        return [r.x for r in df.select("i", build("v").alias("x")).orderBy("i").collect()]

    return run
