"""Each registered query against its SQL counterpart in DuckDB, value by value."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points
from tidepanel.plans import catalog

SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].map(lambda v: None if pd.isna(v) else str(v)[:10] if hasattr(v, "year") else v)
    return df.sort_values(list(df.columns), na_position="last").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, sf_dir, name):
    got = canonical(entry_points.queries()[name](spark, sf_dir).toPandas())
    want = canonical(con.execute(SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        assert same.all(), f"{name}.{c}: {(~same).sum()} differ, {got[c][~same].head(3).tolist()} {want[c][~same].head(3).tolist()}"


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry_points.queries())


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert {r["series"] for r in rows} == {"D1", "D2", "D3", "D4", "D5"}


def test_labels_need_no_exchange_of_prices(spark, sf_dir):
    """The rows that the betas are made on stay where the panel was made: only lines are exchanged, on the code."""
    catalog.market_days(spark, sf_dir)
    plan = catalog.prices(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1


def exchanged(df) -> set[str]:
    """Columns that the exchanges asked for in df's plan carry."""

    def walk(node):
        children = node.children()
        below = set().union(*[walk(children.apply(i)) for i in range(children.size())])
        out = node.output()
        return below | ({out.apply(i).name() for i in range(out.size())} if node.nodeName() == "RepartitionByExpression" else set())

    return walk(df._jdf.queryExecution().optimizedPlan())


def test_bars_are_not_exchanged_again(spark, sf_dir):
    """Rows of every day, and features, are made where the panel's rows are: only lines are exchanged."""
    assert not exchanged(catalog.QUERIES["calendar_densify"](spark, sf_dir)) & {"adj_close", "pbr"}
    assert not exchanged(catalog.QUERIES["feature_table"](spark, sf_dir)) & {"adj_close", "pbr"}
