import datetime as dt
import json
import re

import pytest
from panel_helpers import column
from pyspark.sql import functions as F

from tidepanel.functions import windows
from tidepanel.operators import beta, clean
from tidepanel.plans.liquidity import LiquidityConfig, build_filtered, read_provenance
from tidepanel.plans.preprocess import PanelConfig, preprocess
from tidepanel.sources import panel as src
from tidepanel.sources import scratch
from tidepanel.sources.results import market_series_from_files, merge_predictions, read_market_series, read_predictions
from tidepanel.sources.trades import build_panel


def test_csv_years_bom_and_load_order(spark, tmp_path):
    (tmp_path / "2018.csv").write_text("﻿code,date,etl_adj_close,extra\n01,2018-01-02,10,x\n01,2018-01-02,11,y\n", encoding="utf-8")
    (tmp_path / "2020.csv").write_text("date,code,etl_adj_close\n2020-01-02,01,12\n2020-01-03,02,bad\n", encoding="utf-8")
    df = src.load_panel(spark, str(tmp_path), 2017, 2020, "csv")
    assert df.count() == 4
    kept = clean.dedup_last(df)
    assert column(kept, "adj_close") == [11.0, 12.0, None]
    assert column(kept, "code") == ["01", "01", "02"]
    last = src.latest_date(spark, str(tmp_path), 2017, 2022, "csv").first()
    assert last["latest_date"] == dt.date(2020, 1, 3)
    with pytest.raises(FileNotFoundError):
        src.load_panel(spark, str(tmp_path), 2001, 2002, "csv")


def test_window_scan_needs_every_year(spark, tmp_path):
    rows = [("a", dt.date(y, 5, 1), None if y == 2019 else 1) for y in (2018, 2019, 2020)]
    src.write_years(spark.createDataFrame(rows, "code STRING, date DATE, t INT"), str(tmp_path / "f"))
    assert src.window_scan(spark, str(tmp_path / "f"), 2018, "t").count() == 2
    with pytest.raises(FileNotFoundError):
        src.window_scan(spark, str(tmp_path / "f"), 2019, "t")
    assert src.range_scan(spark, str(tmp_path / "f"), 2010, 2030, "t").count() == 3
    with pytest.raises(ValueError):
        src.range_scan(spark, str(tmp_path / "f"), 2010, 2030, "label")


def test_window_scan_prunes_partitions(spark, tmp_path):
    rows = [("a", dt.date(y, 5, 1), 1) for y in range(2015, 2021)]
    src.write_years(spark.createDataFrame(rows, "code STRING, date DATE, t INT"), str(tmp_path / "f"))
    plan = src.window_scan(spark, str(tmp_path / "f"), 2016, "t").select("code")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [year" in plan and "IsNotNull(t)" in plan


def test_params_and_feature_list(spark, tmp_path):
    f = tmp_path / "p.json"
    f.write_text(json.dumps({"max_depth": 3}))
    assert src.load_params(spark, path=str(f)) == {"max_depth": 3}
    assert src.load_params(spark, inline={"a": 1}) == {"a": 1}
    with pytest.raises(ValueError):
        src.load_params(spark, inline={})
    names = tmp_path / "features.csv"
    names.write_text("feature\nx\ny\nx\ncode\n")
    assert src.feature_list(spark, str(names), ["beta", "y"], {"code"}) == ["x", "y", "beta"]


def test_predictions_csv_and_merge(spark, tmp_path):
    for w, prob in (("2014_2016", 0.1), ("2015_2017", 0.9)):
        (tmp_path / w).mkdir()
        (tmp_path / w / "predictions.csv").write_text(f"code,date,return,y_true,y_prob,y_pred\n007,2016-01-04,0.01,1,{prob},0\n")
    df = read_predictions(spark, str(tmp_path), "csv")
    assert {r["window"] for r in df.collect()} == {"2014_2016", "2015_2017"}
    one = merge_predictions(df).collect()
    assert [(r["code"], r["window"], r["y_prob"]) for r in one] == [("007", "2014_2016", 0.1)]


def test_market_series(spark, tmp_path):
    rows = [("f1", dt.date(2020, 1, 1), 1.0), ("f1", dt.date(2020, 1, 1), 1.0), ("f2", dt.date(2020, 1, 1), 4.0), ("f2", dt.date(2020, 1, 2), None)]
    df = market_series_from_files(spark.createDataFrame(rows, "file STRING, date DATE, v DOUBLE"), "file", "v")
    assert column(df, "v", ("date",)) == [2.5, None]
    (tmp_path / "market_return_series.csv").write_text("date,market_return_fwd\n2020-01-01,0.5\n")
    assert read_market_series(spark, str(tmp_path)).first()["market_return_fwd"] == 0.5


def test_yearly_csv_features(spark, tmp_path):
    rows = [(f"0{c}", dt.date(y, 5, c + 1), None if c == 2 else 1.5 * c, 0.1 * c, c % 2) for y in (2018, 2019, 2020) for c in range(4)]
    df = spark.createDataFrame(rows, "code STRING, date DATE, x DOUBLE, market_return_fwd DOUBLE, t INT")
    root = str(tmp_path / "f")
    src.write_years(df, root, "csv")
    back = src.window_scan(spark, root, 2018, "t", "csv")
    key = lambda r: (r["code"], r["date"])
    got = sorted(back.select("code", "date", "x", "t", "year").collect(), key=key)
    assert [(r["code"], r["date"], r["x"], r["t"], r["year"]) for r in got] == sorted((c, d, x, t, d.year) for c, d, x, _, t in rows)
    assert src.range_scan(spark, root, 2010, 2019, "t", "csv").count() == 8
    with pytest.raises(FileNotFoundError):
        src.window_scan(spark, root, 2019, "t", "csv")
    series = read_market_series(spark, root, fmt="csv")
    assert series.count() == 12 and series.agg(F.sum("market_return_fwd")).first()[0] == pytest.approx(1.8)


def test_a_cached_series_without_the_column_is_an_error(spark, tmp_path):
    (tmp_path / "market_return_series.csv").write_text("date,other\n2020-01-01,0.5\n")
    with pytest.raises(Exception, match="market_return_fwd"):
        read_market_series(spark, str(tmp_path))


def test_filtered_folder_is_reused_with_provenance(spark, tmp_path):
    rows = [(f"c{i}", dt.date(y, 3, 1), float(i + 1), float(50 - i), 1) for y in (2018, 2019) for i in range(20)]
    df = spark.createDataFrame(rows, "code STRING, date DATE, amount DOUBLE, market_value DOUBLE, excess_return_tick INT")
    src.write_years(df, str(tmp_path / "f"))
    cfg = LiquidityConfig(window_start=2018, window_end=2019)
    out = build_filtered(spark, str(tmp_path / "f"), str(tmp_path / "liq"), cfg)
    first = spark.read.parquet(out)
    assert first.count() == 8
    files = sorted(first.inputFiles())
    assert build_filtered(spark, str(tmp_path / "f"), str(tmp_path / "liq"), cfg) == out
    assert sorted(spark.read.parquet(out).inputFiles()) == files
    meta = read_provenance(spark, out.removesuffix("/features"))
    assert (meta["rows_before"], meta["rows_after"], meta["tag"]) == (40, 8, "f3_w101004_w201896_kr02000")
    assert read_provenance(spark, str(tmp_path / "nothing")) is None


def _liquid(years, scale=1.0):
    return [(f"c{i}", dt.date(y, 3, 1), scale * (i + 1), float(50 - i), 1) for y in years for i in range(20)]


LIQUID = "code STRING, date DATE, amount DOUBLE, market_value DOUBLE, excess_return_tick INT"


def _files(spark, path):
    files = spark.read.parquet(path).inputFiles()
    return {y: sorted(f for f in files if f"year={y}/" in f) for y in (2018, 2019, 2020)}


def test_only_a_changed_year_is_filtered_again(spark, tmp_path):
    source, cfg = str(tmp_path / "f"), LiquidityConfig(window_start=2018, window_end=2020)
    src.write_years(spark.createDataFrame(_liquid([2018, 2019]), LIQUID), source)
    build = lambda c=cfg: build_filtered(spark, source, str(tmp_path / "liq"), c)
    first = _files(spark, build())
    src.write_years(spark.createDataFrame(_liquid([2019, 2020], 0.5), LIQUID), source, keep_others=True)
    second = _files(spark, build())
    assert second[2018] == first[2018] and second[2019] != first[2019] and second[2020]
    rows = spark.read.parquet(build()).groupBy("year").agg(F.max("amount").alias("top"), F.count("*").alias("n")).orderBy("year").collect()
    assert [(r["year"], r["n"]) for r in rows] == [(2018, 4), (2019, 4), (2020, 4)]
    assert rows[0]["top"] == 2 * rows[1]["top"] > 0
    # A year with too few names to keep one: its old rows go.
    src.write_years(spark.createDataFrame(_liquid([2020])[:3], LIQUID), source, keep_others=True)
    assert _files(spark, build())[2020] == []
    assert _files(spark, build(LiquidityConfig(window_start=2019, window_end=2020)))[2018] == []


def test_a_half_written_folder_is_not_reused(spark, tmp_path, monkeypatch):
    from tidepanel.plans import liquidity

    source, cfg = str(tmp_path / "f"), LiquidityConfig(window_start=2018, window_end=2019)
    src.write_years(spark.createDataFrame(_liquid([2018, 2019]), LIQUID), source)
    with monkeypatch.context() as m:
        m.setattr(liquidity, "provenance", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            build_filtered(spark, source, str(tmp_path / "liq"), cfg)
    half = _files(spark, f"{tmp_path}/liq/f3_w101004_w201896_kr02000/features")
    whole = build_filtered(spark, source, str(tmp_path / "liq"), cfg)
    assert _files(spark, whole) != half and _files(spark, whole)[2019]
    assert read_provenance(spark, whole.removesuffix("/features"))["rows_after"] == 8


def test_scratch_uses_the_configured_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "_folders", {})
    conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: str(tmp_path))})()
    named = type("Session", (), {"sparkContext": spark.sparkContext, "conf": conf})()
    assert scratch.folder(named).startswith(str(tmp_path))
    assert scratch.folder(named) == scratch.folder(named)


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    monkeypatch.setattr(scratch, "_folders", {})
    conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: None)})()
    context = type("Context", (), {"applicationId": "x", "master": "yarn", "getConf": staticmethod(lambda: conf)})()
    with pytest.raises(RuntimeError):
        scratch.folder(type("Session", (), {"sparkContext": context, "conf": conf})())


def test_next_code_value_is_the_same_when_codes_are_split(spark, monkeypatch):
    monkeypatch.setattr(beta, "RANGE_ROWS", 3)
    known = {2, 5, 6, 11}
    rows = [(f"c{i:02}", dt.date(2020, 1, d), float(i * 10 + d) if i in known and d > 1 else None) for i in range(14) for d in (1, 2, 3)]
    df = spark.createDataFrame(rows, "code STRING, date DATE, v DOUBLE")
    want = {f"c{i:02}": next((j * 10.0 + 2 for j in sorted(known) if j > i), None) for i in range(14)}
    for task_rows in (None, 0):
        assert {r["code"]: r["__next"] for r in beta.next_code_value(df, "v", task_rows).collect()} == want


def test_preprocess_end_to_end_and_no_look_ahead(spark, sf_dir, tmp_path):
    """From yearly raw tables to features; changing what comes later changes no feature of earlier days."""
    panel = build_panel(spark, sf_dir).filter("code in ('1', '2', '3')").filter(F.year("date").between(1995, 1997))
    src.write_years(panel, str(tmp_path / "raw"))
    cfg = PanelConfig(1995, 1997, str(tmp_path / "raw"), extended=True)
    full = preprocess(spark, cfg)
    cut = dt.date(1996, 12, 31)
    src.write_years(panel.filter(F.col("date") <= cut), str(tmp_path / "early"))
    early = preprocess(spark, PanelConfig(1995, 1997, str(tmp_path / "early"), extended=True))
    labels = {"return", "excess_return", "return_tick", "return_tick_0", "excess_return_tick", "market_return_fwd", "year"}
    # Estimation variance is filled backwards in time by definition, so beta may look ahead in its warm-up.
    cols = [c for c in full.columns if c not in labels | {"code", "date", "beta"} and dict(full.dtypes)[c] == "double"]
    a = full.filter(F.col("date") <= cut).select("code", "date", *cols).toPandas().sort_values(["code", "date"])
    b = early.select("code", "date", *cols).toPandas().sort_values(["code", "date"])
    assert len(a) == len(b) > 500
    for c in cols:
        assert a[c].to_numpy() == pytest.approx(b[c].to_numpy(), nan_ok=True, rel=1e-9, abs=1e-9), c
    assert {"RSI_5", "MACD_Hist", "ret_ytd", "capm_beta_252", "days_to_cover_rank", "eps_ttm"} <= set(cols)


def test_config_needs_two_years():
    with pytest.raises(ValueError):
        PanelConfig(2020, 2021)
    PanelConfig(2020, 2021, skip_year_check=True)


def test_the_exchange_by_code_grows_with_the_files_read(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(20_000).selectExpr("cast(id % 50 as string) code", "rand(1) x").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert windows.exchange_parts(df) == session
    assert windows.exchange_parts(df, 10_000) > session
    assert windows.exchange_parts(spark.range(5)) == session


def test_lines_are_exchanged_once_on_the_code(spark, sf_dir):
    """The bars need no exchange on code and date, nor a second one on the code; lines of a hot code are added up first."""
    plan = build_panel(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(code#" in plan
    assert not re.search(r"hashpartitioning\(code#\d+L?, \S+, \d+\)", plan)
    assert plan.count("REPARTITION_BY_NUM") == 1
    hot = build_panel(spark, sf_dir, task_rows=1)
    assert hot.exceptAll(build_panel(spark, sf_dir)).count() == 0
    assert hot.count() == build_panel(spark, sf_dir).count()


def test_parts_of_an_exchange_are_whole_multiples_of_the_session_s(spark, tmp_path):
    spark.range(20_000).write.parquet(str(tmp_path / "t"))
    df, session = spark.read.parquet(str(tmp_path / "t")), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all(windows.exchange_parts(df, n) % session == 0 for n in (1_000, 3_000, 7_000, 10_000))
