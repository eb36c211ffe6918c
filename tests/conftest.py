import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def series(spark):
    """rows -> DataFrame(code, date, columns...) with one row per consecutive day from 2020-01-01."""
    import datetime as dt

    def make(data: dict[str, list[dict]], start=dt.date(2020, 1, 1)):
        names = sorted({k for rows in data.values() for r in rows for k in r if k != "date"})
        out = []
        for code, rows in data.items():
            for i, r in enumerate(rows):
                day = r.get("date", start + dt.timedelta(days=i))
                out.append((code, day, *(None if r.get(n) is None else float(r[n]) for n in names)))
        return spark.createDataFrame(out, "code STRING, date DATE, " + ", ".join(f"{n} DOUBLE" for n in names))

    return make
