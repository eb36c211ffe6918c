"""Features against an independent pandas computation, and warm-up values on tiny inputs."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from panel_helpers import column
from pyspark.sql import functions as F

from tidepanel.functions.windows import by_code, rolling_variance, run_stages
from tidepanel.operators import flow, fundamentals, indicators, labels
from tidepanel.plans import catalog, preprocess


@pytest.fixture(scope="module")
def walk(series):
    rng, data = random.Random(7), {}
    for code in ("a", "b"):
        px, rows = 100.0, []
        for _ in range(300):
            px *= 1 + rng.gauss(0, 0.02)
            rows.append({"adj_close": px, "high": px * 1.02, "low": px * 0.97, "volume": rng.randint(1, 50), "adj_open": px * 0.99})
        data[code] = rows
    return series(data)


def both(df, cols):
    out = df.select("code", "date", *cols).toPandas().sort_values(["code", "date"]).reset_index(drop=True)
    return out


def test_indicators_equal_pandas(walk):
    df = by_code(walk)
    for fn in (indicators.rsi, indicators.ema, indicators.macd, indicators.kd, indicators.atr, indicators.sma, indicators.bollinger, indicators.cci, indicators.williams_r):
        df = fn(df)
    got = df.toPandas().sort_values(["code", "date"]).reset_index(drop=True)
    for _, g in got.groupby("code"):
        x, hi, lo = g["adj_close"], g["high"], g["low"]
        d = x.diff()
        for w in (5, 240):
            gain = d.clip(lower=0).ewm(alpha=1 / w, adjust=False).mean()
            loss = (-d.clip(upper=0)).ewm(alpha=1 / w, adjust=False).mean()
            r = 100 - 100 / (1 + gain / (loss + 1e-9))
            r.iloc[:w] = -1
            np.testing.assert_allclose(g[f"RSI_{w}"], r, rtol=1e-9)
            np.testing.assert_allclose(g[f"EMA_{w}"], x.ewm(span=w, adjust=False).mean(), rtol=1e-11)
            np.testing.assert_allclose(g[f"SMA_{w}"], x.rolling(w).mean().fillna(x), rtol=1e-11)
        line = x.ewm(span=12, adjust=False).mean() - x.ewm(span=26, adjust=False).mean()
        np.testing.assert_allclose(g["MACD_Hist"], line - line.ewm(span=9, adjust=False).mean(), atol=1e-10)
        np.testing.assert_allclose(g["BB_Upper_20"], (x.rolling(20).mean() + 2 * x.rolling(20).std()).fillna(0), rtol=1e-9)
        ll, hh = lo.rolling(9).min(), hi.rolling(9).max()
        k, ks = 50.0, []
        for v in 100 * (x - ll) / (hh - ll + 1e-9):
            if np.isnan(v):
                ks.append(50.0)
            else:
                k = k * 2 / 3 + v / 3
                ks.append(k)
        np.testing.assert_allclose(g["K"], ks, rtol=1e-9)
        tp = (hi + lo + x) / 3
        mad = tp.rolling(14).apply(lambda v: np.abs(v - v.mean()).mean(), raw=True)
        np.testing.assert_allclose(g["CCI_14"], ((tp - tp.rolling(14).mean()) / (0.015 * mad + 1e-9)).fillna(0), rtol=1e-7, atol=1e-8)
        assert g["Williams_R_14"].between(-100, 0).all()


def test_labels_look_two_days_ahead(series):
    df = series({"a": [{"adj_open": o, "beta": 1, "market_return_fwd": 0.005} for o in (9, 10, 10.05, 20, 20.02)]})
    out = labels.add_labels(df)
    assert column(out, "return") == pytest.approx([0.005, 0.15, 0.001, None, None], abs=1e-8)
    assert column(out, "return_tick") == [0, 1, 0, None, None]
    assert column(out, "return_tick_0") == [1, 1, 1, None, None]
    assert column(out, "excess_return")[1] == pytest.approx(0.145, abs=1e-8)


def test_one_row_code_takes_all_warm_up_values(series):
    df = series({"a": [{"adj_close": 10, "high": 11, "low": 9, "close": 10, "volume": 5, "daily_return": 0, "market_return": 0, "margin_balance": None, "ms_balance": None}]})
    for fn in (indicators.rsi, indicators.sma, indicators.kd, indicators.williams_r, indicators.bollinger, indicators.obv, flow.capm_betas, flow.flow_basic):
        df = fn(df)
    r = df.first()
    assert (r["RSI_5"], r["SMA_20"], r["K"], r["D"], r["Williams_R_14"], r["BB_Upper_20"], r["OBV"]) == (-1, 10, 50, 50, -50, 0, 0)
    assert (r["capm_beta_252"], r["maintenance_ratio"]) == (1, 130)


def test_zero_denominators(series):
    vol = [1, 0, 0, 0, 0, 5, 5]
    px = [10, 10, 10, 10, 10, 10, 11]
    out = indicators.obv(series({"a": [{"adj_close": p, "volume": v} for p, v in zip(px, vol, strict=True)]}))
    assert column(out, "OBV_ROC") == [0, 0, 0, 0, 0, 0, float("inf")]
    out = fundamentals.short_change(series({"a": [{"sl_sell_balance": v} for v in (0, 0, 4, 1, 1, 5, 0, 1)]}))
    assert column(out, "short_balance_chg_5d") == [0, 0, 0, 0, 0, 2, 0, -0.75]


def test_revenue_growth_needs_63_values(series):
    rows = [{"monthly_revenue": 100.0 + i} for i in range(130)]
    got = both(fundamentals.revenue_growth(series({"a": rows, "b": rows[:62]})), ["rev_chg_63"])
    rev = pd.Series([r["monthly_revenue"] for r in rows])
    r3 = rev.rolling(63, min_periods=31).sum()
    want = (r3 / (r3.shift(63).abs() + 1e-9) - 1).clip(-2, 10).fillna(0)
    np.testing.assert_allclose(got[got.code == "a"]["rev_chg_63"], want, rtol=1e-9)
    assert (got[got.code == "b"]["rev_chg_63"] == 0).all()


def test_groups_without_inputs_are_left_out(series):
    df = series({"a": [{"dealer_net": 5.0}]})
    assert flow.flow_basic(df).columns == df.columns
    assert set(flow.flow_period_to_date(df).columns) - set(df.columns) == {"dealer_net_wtd", "dealer_wtd_k", "dealer_mtd_k", "dealer_mtd_k2", "dealer_ytd_k"}
    assert "inst_buy_days_20" not in flow.flow_buy_days(df).columns
    assert F is not None


def test_label_histogram_counts_every_row(walk):
    df = labels.add_labels(walk.withColumn("beta", F.lit(1.0)).withColumn("market_return_fwd", F.lit(0.0)))
    h = labels.label_histogram(df, "return", bins=10).orderBy("bin").collect()
    x = df.toPandas()["return"].dropna()
    want, edges = np.histogram(x, bins=10)
    assert [r["n_rows"] for r in h] == want.tolist()
    assert [r["bin_low"] for r in h] == pytest.approx(edges[:-1].tolist())
    assert h[0]["median"] == pytest.approx(x.median()) and h[0]["mean"] == pytest.approx(x.mean())


def test_label_queries_carry_prices_only(spark, sf_dir):
    """The labels' table holds what labels and scores read; the yearly table has all columns, written without an exchange of wide rows."""
    df = catalog.labelled(spark, sf_dir)
    assert "fii_net" not in df.columns and "excess_return_tick" in df.columns
    wide = catalog.labelled_panel(spark, sf_dir)
    assert set(catalog.PANEL_COLUMNS) <= set(wide.columns)
    assert wide._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 1
    cols = ["code", "date", "return", "excess_return_tick"]
    assert wide.select(*cols).exceptAll(df.select(*cols)).count() == 0


def test_the_rank_is_joined_before_the_rows_are_wide(spark, sf_dir):
    cfg = preprocess.PanelConfig(1995, 2001)
    df = preprocess.build_features(catalog.market_panel(spark, sf_dir).filter("code in ('1', '2', '3')"), cfg)
    plan = df._jdf.queryExecution().executedPlan().toString()
    join = re.search(r"Join \[code#\d+, date#\d+", plan)
    assert join and plan.index("Window [") < join.start()
    assert "days_to_cover_rank" in df.columns and "__cover_rank" not in df.columns


def test_rolling_variance_equals_pandas(series):
    values = [None if i % 11 == 3 else (i * 37 % 101) / 20 - 2.5 for i in range(200)]
    df = run_stages(by_code(series({"a": [{"x": v} for v in values]})), rolling_variance("t", "x", {"v": (60, 30)}))
    got = [r["v"] for r in df.orderBy("date").collect()]
    want = pd.Series(values, dtype=float).rolling(60, min_periods=30).var()
    assert all((g is None) == pd.isna(w) and (g is None or abs(g - w) < 1e-12) for g, w in zip(got, want))
