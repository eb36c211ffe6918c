import datetime as dt
import math

import pytest
from panel_helpers import column
from pyspark.sql import functions as F

from tidepanel.functions import ordered
from tidepanel.operators import backtest as bt
from tidepanel.operators import crosssec
from tidepanel.plans.liquidity import tag
from tidepanel.plans.report import build_report

DAY = dt.date(2020, 1, 1)


def days(n):
    return [DAY + dt.timedelta(days=i) for i in range(n)]


def test_decile_ties_nulls_and_small_days(spark):
    rows = [(f"c{i:02}", DAY, 0.5 if i < 4 else 0.1 * (i % 4) + 0.001 * i) for i in range(12)]
    rows += [("null", DAY, None)]
    rows += [(f"c{i:02}", days(2)[1], float(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "code STRING, date DATE, y_prob DOUBLE")
    plain = crosssec.assign_deciles(df)
    split = crosssec.assign_deciles(df, task_rows=0)
    got = {(r["code"], r["date"]): r["decile"] for r in plain.collect()}
    assert got == {(r["code"], r["date"]): r["decile"] for r in split.collect()}
    assert got["null", DAY] is None
    assert all(got[f"c{i:02}", days(2)[1]] is None for i in range(9))
    # rank / size * n, rounded up; equal scores follow the order of codes
    assert [got[f"c{i:02}", DAY] for i in range(4)] == [math.ceil(k / 12 * 10) for k in (1, 2, 3, 4)]


def test_decile_returns_cost_and_capital(spark):
    rows = [("a", DAY, 0.02, 1), ("b", DAY, 0.04, 1), ("c", DAY, -0.01, 2), ("d", DAY, 0.5, None)]
    df = spark.createDataFrame(rows, "code STRING, date DATE, return DOUBLE, decile INT")
    wide = bt.decile_table(bt.decile_daily_returns(df, cost_bps=10, capital_usage=0.5), 2).first()
    assert wide["D1"] == pytest.approx((0.03 - 0.002) * 0.5)
    assert wide["D2"] == pytest.approx((-0.01 - 0.002) * 0.5)


def test_performance_metrics(spark):
    rs = [0.1, -0.5, 0.2, None, 0.3]
    df = spark.createDataFrame([("s", d, r) for d, r in zip(days(5), rs, strict=True)], "series STRING, date DATE, ret DOUBLE")
    m = bt.performance_metrics(df).first()
    growth = 1.1 * 0.5 * 1.2 * 1.3
    assert m["n_days"] == 4
    assert m["ann_return"] == pytest.approx(growth ** (252 / 4) - 1)
    assert m["mdd"] == pytest.approx(-0.5)
    assert m["hit_rate"] == 0.75
    flat = df.withColumn("ret", F.lit(0.0))
    f = bt.performance_metrics(flat).first()
    assert f["sharpe"] is None and f["calmar"] is None and f["mdd"] == 0


def test_alpha_needs_more_than_ten_days(spark):
    def build(n):
        rows = [(s, d, 0.01 * (i % 3) + k) for i, d in enumerate(days(n)) for s, k in (("D1", 0.001), ("market", 0.0))]
        rows = [(s, d, r if s == "market" or d.day % 2 else r + 0.001) for s, d, r in rows]
        return bt.alpha_ir(spark.createDataFrame(rows, "series STRING, date DATE, ret DOUBLE")).first()

    assert build(10)["alpha"] is None and build(10)["ir"] is None
    assert build(11)["alpha"] > 0 and build(11)["ir"] > 0


def test_drawdown_episodes(spark):
    dd = [0, -0.1, -0.3, 0, 0, -0.2, -0.1, 0, -0.05]
    curve = spark.createDataFrame(list(zip(days(9), map(float, dd), strict=True)), "date DATE, dd DOUBLE")
    got = [tuple(r) for r in bt.drawdown_episodes(curve).orderBy("depth").collect()]
    d = days(9)
    assert got == [
        (d[0], d[2], d[3], -0.3, 2, 3, False),
        (d[4], d[5], d[7], -0.2, 1, 3, False),
        (d[7], d[8], None, -0.05, 1, 1, True),
    ]
    top = bt.drawdown_topk(bt.drawdown_episodes(curve), 1).collect()
    assert [(r["rank"], r["longest"]) for r in top] == [(1, True)]


def test_drawdown_from_the_first_day(spark):
    curve = spark.createDataFrame(list(zip(days(3), (-0.1, -0.2, 0.0), strict=True)), "date DATE, dd DOUBLE")
    r = bt.drawdown_episodes(curve).first()
    assert (r["peak"], r["trough"], r["recovery"]) == tuple(days(3))


def test_strategy_beta_warm_up_and_full(spark):
    n = 80
    rows = [(d, 2 * m + 0.001, m) for d, m in ((d, 0.01 * math.sin(i)) for i, d in enumerate(days(n)))]
    df = spark.createDataFrame(rows, "date DATE, s DOUBLE, m DOUBLE")
    for mode in ("rolling", "expanding", "full"):
        assert column(bt.strategy_beta(df, mode), "beta", ("date",)) == pytest.approx([2.0] * n)
    short = bt.strategy_beta(df.limit(20), "rolling")
    assert column(short, "beta", ("date",)) == [1.0] * 20
    flat = df.withColumn("m", F.lit(0.0))
    assert bt.strategy_beta(flat, "full").first()["beta"] == 1.0
    assert bt.beta_neutral_excess(df).agg(F.max(F.abs(F.col("excess") - 0.001))).first()[0] < 1e-9


@pytest.fixture
def liquid(spark):
    rows = [(f"c{i:02}", DAY, float(10 + 7 * i % 50), float(100 + 13 * i % 90)) for i in range(30)]
    rows += [("zero", DAY, 0.0, 5.0), ("none", DAY, None, 5.0)]
    rows += [(f"c{i:02}", days(2)[1], 5.0, 5.0) for i in range(5)]
    return spark.createDataFrame(rows, "code STRING, date DATE, amount DOUBLE, market_value DOUBLE")


def test_liquidity_mask(liquid, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 4)
    kept = {(r["code"], r["date"]) for r in crosssec.liquidity_mask(liquid).filter("liq_keep").collect()}
    assert len(kept) == 6  # 20 % of the 30 scored names; a day of equal amounts has no score
    assert all(d == DAY and c.startswith("c") for c, d in kept)
    for task_rows in (None, 0):
        got = {(r["code"], r["date"]) for r in crosssec.filter_liquid(liquid, task_rows=task_rows).collect()}
        assert got == kept
    with pytest.raises(KeyError):
        crosssec.liquidity_mask(liquid.drop("amount"))


def test_liquidity_tag():
    assert tag(0.1004, 0.1896, 0.2) == "f3_w101004_w201896_kr02000"


def test_vol_weights_average_one_and_rank_down(spark):
    rows = [(f"c{i}", DAY, None if i == 3 else float(i % 4)) for i in range(10)]
    df = spark.createDataFrame(rows, "code STRING, date DATE, vol20 DOUBLE")
    out = crosssec.vol_rank_weights(df, []).collect()
    assert sum(r["weight"] for r in out) / len(out) == pytest.approx(1)
    by_vol = sorted((r["vol20"], r["weight"]) for r in out if r["vol20"] is not None)
    assert all(a[1] >= b[1] for a, b in zip(by_vol, by_vol[1:], strict=False))


def test_report_has_all_tables(spark):
    rows = [
        (f"{w}", f"c{i:02}", d, 0.01 * math.sin(i * 7 + k), 1, (i * 37 % 101) / 101, 1)
        for k, d in enumerate(days(40))
        for i in range(12)
        for w in ("2018_2020", "2019_2021")
    ]
    preds = spark.createDataFrame(rows, "window STRING, code STRING, date DATE, return DOUBLE, y_true INT, y_prob DOUBLE, y_pred INT")
    market = spark.createDataFrame([(d, 0.001 * (k % 5 - 2)) for k, d in enumerate(days(39))], "date DATE, market_return_fwd DOUBLE")
    tables = build_report(preds, market)
    assert tables["daily_returns"].count() == 40
    assert tables["daily_returns"].filter("market is null").count() == 1
    assert tables["decile_metrics"].count() == 12
    for df in tables.values():
        df.collect()
