import datetime as dt
import re

import pytest
from panel_helpers import column
from pyspark.sql import functions as F

from tidepanel.operators import clean, market
from tidepanel.sources.panel import coerce_types, map_columns

D = [dt.date(2020, 1, d) for d in (1, 2, 3, 6)]


def test_dedup_keeps_last_loaded(spark):
    rows = [("a", D[0], 1.0, 1), ("a", D[0], 2.0, 3), ("a", D[0], 9.0, 2), ("b", D[0], None, 1)]
    df = clean.dedup_last(spark.createDataFrame(rows, "code STRING, date DATE, x DOUBLE, __ordinal INT"))
    assert column(df, "x") == [2.0, None]


def test_sparse_and_text_columns(spark):
    rows = [(str(i), D[0], None if i else 1.0, "x" if i % 7 == 0 else str(i), "x" if i % 2 else "1", True) for i in range(200)]
    df = spark.createDataFrame(rows, "code STRING, date DATE, rare DOUBLE, mostly STRING, half STRING, flag BOOLEAN")
    out = clean.salvage_numeric(clean.drop_sparse(df))
    assert out.columns == ["code", "date", "mostly"]
    assert dict(out.dtypes)["mostly"] == "double"


@pytest.fixture
def sparse(spark):
    rows = [
        ("full", D[0], 10.0, 1.0), ("full", D[1], None, None), ("full", D[2], 12.0, 3.0), ("full", D[3], 13.0, 4.0),
        ("late", D[0], None, 7.0), ("late", D[2], 20.0, None),
        ("never", D[1], None, 5.0),
    ]
    return spark.createDataFrame(rows, "code STRING, date DATE, adj_close DOUBLE, volume DOUBLE")


def test_densify(sparse):
    rows = {(r["code"], r["date"]): (r["adj_close"], r["volume"]) for r in clean.densify(sparse).collect()}
    assert [rows["full", d] for d in D] == [(10, 1), (10, 1), (12, 3), (13, 4)]
    # Rows before the first price are cut, and their values are not carried over the cut.
    assert ("late", D[0]) not in rows and ("late", D[1]) not in rows
    assert [rows["late", d] for d in D[2:]] == [(20, 0), (20, 0)]
    # A code that never has a price keeps every day.
    assert [rows["never", d] for d in D] == [(None, 0), (None, 5), (None, 5), (None, 5)]


def test_densify_uses_one_wide_exchange(sparse):
    plan = clean.densify(sparse)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "SortMergeJoin" not in plan


def test_coerce(spark):
    df = spark.createDataFrame([("1", "2020-01-01", "3.5", float("nan")), ("2", "2020-01-02", "-", 2.0)], "code STRING, date STRING, x STRING, y DOUBLE")
    out = coerce_types(df)
    assert dict(out.dtypes) == {"code": "string", "date": "date", "x": "double", "y": "double"}
    assert column(out, "x") == [3.5, None]
    assert column(out, "y") == [None, 2.0]


def test_mapping_keeps_unknown_and_reports_missing(spark):
    df, missing = map_columns(spark.createDataFrame([("a", "d", 1.0, 2.0)], "code STRING, date STRING, etl_adj_close DOUBLE, other DOUBLE"))
    assert df.columns == ["code", "date", "adj_close", "other"]
    assert "close" in missing and "adj_close" not in missing


def test_market_returns_pad_gaps(spark):
    rows = [("a", D[0], 100.0), ("b", D[0], 100.0), ("a", D[1], None), ("a", D[2], 110.0), ("a", D[3], 99.0)]
    df = market.add_market_returns(spark.createDataFrame(rows, "code STRING, date DATE, market_index DOUBLE"))
    got = {(r["code"], r["date"]): (r["market_return"], r["market_return_fwd"]) for r in df.collect()}
    assert got["a", D[0]] == pytest.approx((0, 0)) == got["b", D[0]]
    assert got["a", D[1]] == pytest.approx((0, 0.1))
    assert got["a", D[2]] == pytest.approx((0.1, -0.1))
    assert got["a", D[3]] == pytest.approx((-0.1, 0))


def test_market_returns_without_index(spark):
    df = market.add_market_returns(spark.createDataFrame([("a", D[0])], "code STRING, date DATE"))
    assert df.first().asDict() == {"code": "a", "date": D[0], "market_return": 0.0, "market_return_fwd": 0.0}


def test_market_index_of_a_day_is_that_of_the_first_code(spark):
    rows = [("b", D[0], 1.0), ("a", D[0], None), ("c", D[0], 9.0), ("b", D[1], 7.0), ("a", D[1], 2.0)]
    df = spark.createDataFrame(rows, "code STRING, date DATE, market_index DOUBLE").repartition(4)
    assert column(market.market_series(df), "market_return", ("date",)) == [None, 1.0]


def test_densify_carries_decimals(spark):
    rows = [("a", D[0], 1.0, "1.5"), ("a", D[2], 2.0, None), ("b", D[1], 3.0, "2.5")]
    df = spark.createDataFrame(rows, "code STRING, date DATE, adj_close DOUBLE, x STRING").withColumn("x", F.col("x").cast("decimal(10,2)"))
    got = {(r["code"], r["date"]): float(r["x"]) for r in clean.densify(df).collect()}
    assert [got["a", d] for d in D[:3]] == [1.5, 1.5, 1.5] and got["b", D[2]] == 2.5


def test_repair_market(spark):
    rows = [("a", D[0], None), ("a", D[1], 2.0), ("a", D[2], None)]
    df = clean.repair_market(spark.createDataFrame(rows, "code STRING, date DATE, market_index DOUBLE"))
    assert column(df, "market_index") == [0, 2, 2]


def test_null_rates(sparse):
    got = {r["column"]: r["null_rate"] for r in clean.null_rates(sparse).collect()}
    assert got == pytest.approx({"adj_close": 3 / 7, "volume": 2 / 7})
    assert F is not None


def test_days_are_made_and_mended_on_one_exchange(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1.0, 2.0)], "code string, date date, adj_close double, market_return double")
    plan = clean.repair_market(clean.densify(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1
    assert len(re.findall(r"Exchange hashpartitioning\(code#", plan)) == 1


def test_null_rates_of_kept_rows_need_no_values(spark):
    """One bit a column, over more columns than a number has bits, gives the rates of the rows that are kept."""
    names = [f"v{i}" for i in range(70)]
    data = [("a", dt.date(2020, 1, d), k, *[None if (i + d * k) % 3 == 0 else float(i) for i in range(70)]) for d in (1, 2, 3) for k in (1, 2)]
    df = spark.createDataFrame(data, "code string, date date, ord int, " + ", ".join(f"{n} double" for n in names))
    want = {r["column"]: r["null_rate"] for r in clean.null_rates(clean.dedup_last(df, "ord")).collect()}
    assert {r["column"]: r["null_rate"] for r in clean.kept_null_rates(df, "ord").collect()} == want
    for task_rows in (None, 0):
        assert sorted(clean.dedup_on_code(df, "ord", task_rows).collect()) == sorted(clean.dedup_last(df, "ord").collect())
