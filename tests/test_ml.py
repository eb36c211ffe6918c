import datetime as dt
import json
import random
from dataclasses import replace
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import evaluate, ml
from tidepanel.plans import catalog
from tidepanel.plans.liquidity import LiquidityConfig
from tidepanel.plans.report import BacktestConfig
from tidepanel.plans.run import TrainRun, backtest, train
from tidepanel.plans.walkforward import WalkForward, WalkForwardConfig, should_tune
from tidepanel.sources.panel import write_years
from tidepanel.sources.results import read_predictions

DAY = dt.date(2020, 1, 1)


def test_folds_on_ten_days(spark):
    rows = [(c, DAY + dt.timedelta(days=i)) for i in range(10) for c in "ab"]
    folds = ml.cv_folds(spark.createDataFrame(rows, "code STRING, date DATE"), 3).orderBy("date").collect()
    assert [r["fold"] for r in folds] == [None] * 4 + [1, 1, 2, 2, 3, 3]
    assert {r["test_size"] for r in folds} == {2}


def test_few_days_fall_back_to_rows(spark):
    rows = [(f"c{i}", DAY) for i in range(8)]
    out = ml.with_folds(spark.createDataFrame(rows, "code STRING, date DATE"), 3).orderBy("code").collect()
    assert [r["fold"] for r in out] == [None, None, 1, 1, 2, 2, 3, 3]


def test_one_class_metrics(spark):
    df = spark.createDataFrame([(0, 0.3, 0), (0, 0.6, 1)], "y_true INT, y_prob DOUBLE, y_pred INT")
    m = evaluate.classifier_metrics(df, []).first()
    assert m["log_loss"] is None and m["roc_auc"] is None
    assert (m["precision"], m["recall"], m["f1"], m["accuracy"]) == (0, 0, 0, 0.5)
    t = evaluate.f1_threshold(df.withColumn("oof_prob", F.col("y_prob")), []).first()
    assert t["threshold"] == 0.5
    none = df.withColumn("oof_prob", F.lit(None).cast("double"))
    assert evaluate.f1_threshold(none, []).first()["threshold"] == 0.5


def test_auc_flips_with_labels_and_counts_ties_half(spark):
    rng = random.Random(4)
    rows = [(int(rng.random() < 0.4), round(rng.random(), 1), 1) for _ in range(500)]
    df = spark.createDataFrame(rows, "y_true INT, y_prob DOUBLE, y_pred INT")
    a = evaluate.roc_auc(df, []).first()["roc_auc"]
    b = evaluate.roc_auc(df.withColumn("y_true", 1 - F.col("y_true")), [], task_rows=0).first()["roc_auc"]
    assert a + b == pytest.approx(1)
    pos, neg = [p for y, p, _ in rows if y], [p for y, p, _ in rows if not y]
    want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
    assert a == pytest.approx(want)


def test_threshold_sweep_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(int(rng.random() < 0.3), rng.choice([0.05, 0.07, 0.29, 0.3, 0.69, 0.7, 0.04, rng.random()])) for _ in range(400)]
    df = spark.createDataFrame(rows, "y_true INT, oof_prob DOUBLE")
    curve = {round(r["threshold"], 2): r["f1"] for r in evaluate.f1_by_threshold(df, []).collect()}
    assert len(curve) == 65
    best = (0.0, 0.5)
    for i in range(65):
        t = 0.05 + 0.01 * i
        tp = sum(y for y, p in rows if p >= t)
        f1 = 2 * tp / max(1, sum(p >= t for _, p in rows) + sum(y for y, _ in rows))
        assert curve[round(t, 2)] == pytest.approx(f1)
        if f1 > best[0]:
            best = (f1, round(t, 2))
    assert evaluate.f1_threshold(df, []).first()["threshold"] == best[1]


def test_feature_resolution_and_matrix(spark):
    df = spark.createDataFrame(
        [("a", DAY, 1.0, float("inf"), None, "t", 3.0, 1)],
        "code STRING, date DATE, x DOUBLE, y DOUBLE, z DOUBLE, name STRING, amount DOUBLE, excess_return_tick INT",
    )
    names = ml.resolve_features(df, ml.LIVE_NOT_FEATURES)
    assert names == ["x", "y", "z"]
    assert ml.resolve_features(df, set(), ["z", "gone", "x", "amount"]) == ["z", "x"]
    assert ml.feature_matrix(df, names, ["code"]).first().asDict() == {"code": "a", "x": 1.0, "y": 0.0, "z": 0.0}


def test_retune_policy():
    fixed, every2, free = WalkForwardConfig(), WalkForwardConfig(retune_every_n=2), WalkForwardConfig(freeze_hyperparams=False)
    assert [should_tune(fixed, p, i) for i, p in enumerate([None, {}, {}], 1)] == [True, False, False]
    assert [should_tune(every2, {}, i) for i in (1, 2, 3)] == [True, False, True]
    assert should_tune(free, {}, 5)
    assert [should_tune(WalkForwardConfig(retune_every_n=1), {}, i) for i in (1, 2, 3)] == [True, True, True]


def test_parameters_ignore_what_has_no_counterpart():
    stored = {"learning_rate": 0.02, "num_leaves": 425, "feature_fraction": 0.9, "bagging_fraction": 0.9, "bagging_freq": 20, "min_data_in_leaf": 77, "max_depth": 18}
    p = ml.GbtParams.from_mapping(json.loads(json.dumps(stored)))
    assert (p.learning_rate, p.min_data_in_leaf, p.max_depth) == (0.02, 77, 18)


def test_windows():
    assert ml.walk_forward_windows(2014, 2025)[0] == (2014, 2016)
    assert ml.walk_forward_windows(2014, 2025)[-1] == (2023, 2025)
    assert len(ml.walk_forward_windows(2014, 2025)) == 10


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Three years of rows whose label follows x; 2019 is complete, 2021 is missing."""
    rng, rows = random.Random(6), []
    for year in (2017, 2018, 2019, 2020):
        for i in range(40):
            for c in range(12):
                x = rng.gauss(0, 1)
                y = int(x + rng.gauss(0, 0.5) > 0.5)
                rows.append((f"c{c}", dt.date(year, 1, 1) + dt.timedelta(days=7 * i), x, rng.random(), abs(x), 0.01 * x, y))
    df = spark.createDataFrame(rows, "code STRING, date DATE, x DOUBLE, noise DOUBLE, vol20 DOUBLE, return DOUBLE, excess_return_tick INT")
    root = str(tmp_path_factory.mktemp("features"))
    write_years(df, root)
    return root


def test_walk_forward_learns_and_skips_a_missing_year(spark, planted, tmp_path):
    cfg = WalkForwardConfig(
        window_start=2017, window_end=2021, n_trials=1, n_splits=2, rounds=3, search_rounds=3, patience=2, output_dir=str(tmp_path)
    )
    walk = WalkForward(spark, planted, cfg)
    done = walk.run()
    assert list(walk.failed) == ["2019_2021"]
    rows = walk.summary(done).orderBy("window").collect()
    assert [r["window"] for r in rows] == ["2017_2019", "2018_2020"]
    assert [r["hyperparams_tuned"] for r in rows] == [True, False]
    assert all(r["roc_auc"] > 0.8 and r["vol_weight_used"] for r in rows)
    p = done[0].predictions.agg(F.min("y_prob").alias("lo"), F.max("y_prob").alias("hi"), F.count("*").alias("n")).first()
    assert 0 < p["lo"] <= p["hi"] < 1 and p["n"] == 480
    imp = done[0].importance.orderBy("rank").collect()
    assert imp[0]["feature"] in ("x", "vol20") and [r["rank"] for r in imp] == list(range(1, len(imp) + 1))
    assert set(r["window"] for r in read_predictions(spark, f"{tmp_path}/predictions").select("window").distinct().collect()) == {"2017_2019", "2018_2020"}


def test_a_restart_fits_only_what_is_not_in_the_ledger(spark, planted, tmp_path, monkeypatch):
    root, fitted = str(tmp_path / "features"), []
    write_years(spark.read.parquet(planted).drop("year"), root)
    fit = WalkForward._fit_window
    monkeypatch.setattr(WalkForward, "_fit_window", lambda self, s, e, i: fitted.append(s) or fit(self, s, e, i))

    def run(end, out="out", **changes):
        fitted.clear()
        cfg = WalkForwardConfig(window_start=2017, window_end=end, n_trials=1, n_splits=2, rounds=2, search_rounds=2, patience=1, **changes)
        walk = WalkForward(spark, root, replace(cfg, output_dir=str(tmp_path / out)))
        done = walk.run()
        assert not walk.failed
        return sorted(tuple(sorted(r.asDict().items())) for r in walk.summary(done).collect()), [r.params for r in done]

    run(2019)
    assert fitted == [2017]
    after_restart = run(2020)
    assert fitted == [2018]
    assert run(2020, "anew") == after_restart and fitted == [2017, 2018]
    year = spark.read.parquet(root).filter("year = 2020 AND code <> 'c1'").drop("year").collect()
    write_years(spark.createDataFrame(year, spark.read.parquet(root).drop("year").schema), root, keep_others=True)
    run(2020)
    assert fitted == [2018]
    run(2020, random_state=1)
    assert fitted == [2017, 2018]


def test_oof_leaves_the_first_block_empty(spark, planted):
    df = spark.read.parquet(planted).filter("year = 2017")
    rows = ml.assemble(df, ["x", "noise"], ["code", "date", "excess_return_tick"])
    oof, rounds = ml.oof_probabilities(rows, "excess_return_tick", ml.GbtParams(rounds=3, max_depth=2), 3, patience=2)
    got = oof.groupBy("fold").agg(F.count("oof_prob").alias("n"), F.count("*").alias("all")).orderBy("fold").collect()
    assert [(r["fold"], r["n"], r["all"]) for r in got] == [(None, 0, 120), (1, 120, 120), (2, 120, 120), (3, 120, 120)]
    assert len(rounds) == 3 and all(1 <= r <= 3 for r in rounds)


def test_a_shorter_run_is_the_beginning_of_a_longer_one(spark, planted):
    df = spark.read.parquet(planted).filter("year = 2017")
    rows = ml.assemble(df, ["x", "noise"], ["code", "date", "excess_return_tick"]).withColumn("__y", F.col("excess_return_tick").cast("double"))
    params = {"max_depth": 2, "bagging_fraction": 0.7, "feature_fraction": 0.5}
    short, long = (ml.fit_gbt(rows, "excess_return_tick", ml.GbtParams(rounds=n, **params)).evaluateEachIteration(rows) for n in (3, 6))
    assert long[:3] == pytest.approx(short)


def test_patience_keeps_many_trees_at_a_low_rate(spark, planted):
    df = spark.read.parquet(planted)
    rows = ml.assemble(df, ["x", "noise"], ["code", "date", "excess_return_tick", "year"])
    train, valid = rows.filter("year < 2019"), rows.filter("year = 2019")
    slow = ml.fit_with_patience(train, valid, "excess_return_tick", ml.GbtParams(learning_rate=0.02, max_depth=2, rounds=24), patience=3)
    fast = ml.fit_with_patience(train, valid, "excess_return_tick", ml.GbtParams(learning_rate=1.0, max_depth=5, min_data_in_leaf=1, rounds=24), patience=3)
    assert slow.getNumTrees == 24 and fast.getNumTrees < 24


def test_best_round():
    assert ml.best_round([5, 4, 3, 3, 3, 3], 3) == (3, True)
    assert ml.best_round([5, 4, 3, 3, 2], 3) == (5, False)
    with pytest.raises(ValueError):
        ml.fit_gbt(None, "y", ml.GbtParams(max_depth=31))


def test_stored_parameters_are_taken_as_given(spark, planted):
    df = spark.read.parquet(planted).filter("year = 2017")
    rows = ml.assemble(df, ["x", "noise"], ["code", "date", "excess_return_tick"])
    model = ml.fit_gbt(rows, "excess_return_tick", ml.GbtParams.from_mapping({"max_depth": 18, "min_data_in_leaf": 1, "rounds": 1}))
    assert model.getOrDefault("maxDepth") == 18 and model.trees[0].depth > 8


def test_feature_list_and_weight_column_in_a_window(spark, planted, tmp_path):
    names = tmp_path / "names.csv"
    names.write_text("feature\nx\ngone\n")
    cfg = WalkForwardConfig(
        window_start=2017, window_end=2019, rounds=2, n_splits=2, feature_list_path=str(names), preset_params={"max_depth": 2}
    )
    done = WalkForward(spark, planted, cfg).run()
    assert {r["feature"] for r in done[0].importance.collect()} == {"x", "vol20"}
    assert done[0].metrics.first()["vol_weight_col"] == "vol20"


def test_train_and_backtest_runs(spark, tmp_path):
    rng, rows = random.Random(8), []
    for year in (2017, 2018, 2019):
        for i in range(30):
            for c in range(40):
                x = rng.gauss(0, 1)
                r = 0.01 * x + rng.gauss(0, 0.01)
                rows.append((f"c{c:02}", dt.date(year, 1, 1) + dt.timedelta(days=9 * i), x, 5.0 + c, 100.0 + 3 * c * c, r, r, 1.0, 0.001, int(r > 0.01)))
    df = spark.createDataFrame(
        rows,
        "code STRING, date DATE, x DOUBLE, amount DOUBLE, market_value DOUBLE, return DOUBLE, excess_return DOUBLE, "
        "beta DOUBLE, market_return_fwd DOUBLE, excess_return_tick INT",
    )
    write_years(df, str(tmp_path / "f"))
    run = TrainRun(
        str(tmp_path / "f"),
        str(tmp_path / "exp"),
        window_start=2017,
        window_end=2019,
        params_inline={"learning_rate": 0.2, "max_depth": 3},
        liquidity=LiquidityConfig(keep_ratio=0.5),
        filtered_root=str(tmp_path / "liq"),
        diagnostics=True,
        model=WalkForwardConfig(use_vol_weight=False, n_splits=2, rounds=3),
    )
    done = train(spark, run)
    assert [r.metrics.first()["n_test"] for r in done] == [30 * 20]
    assert not done[0].metrics.first()["hyperparams_tuned"]
    tables = backtest(spark, str(tmp_path / "exp"), str(tmp_path / "f"), str(tmp_path / "report"), BacktestConfig(n_deciles=5))
    top = {r["series"]: r["ann_return"] for r in tables["decile_metrics"].collect()}
    assert top["D1"] > top["D5"]
    assert spark.read.json(str(tmp_path / "report" / "liquidity_filter_meta")).first()["rows_after"] == 1800
    assert spark.read.option("header", True).csv(str(tmp_path / "exp" / "diagnostics" / "labels")).count() == 3600


def test_model_queries_use_the_operators_own_rounds_and_trials(monkeypatch):
    """The registered model queries leave nothing of the search, the walk-forward or a fit out."""
    seen = []
    monkeypatch.setattr(catalog, "WalkForward", lambda spark, root, cfg: seen.append(cfg) or SimpleNamespace(run=list))
    monkeypatch.setattr(catalog, "feature_store", lambda *_: "")
    monkeypatch.setattr(catalog, "shared_path", lambda spark, key, write: write("out"))
    catalog.walk_output(None, "sf")
    assert seen == [WalkForwardConfig(window_start=1995, window_end=2001, output_dir="out")]
    monkeypatch.setattr(catalog, "_once", lambda spark, key, make: make())
    monkeypatch.setattr(catalog, "_binned", lambda *_: None)
    monkeypatch.setattr(catalog.boosting, "search", lambda data, draws, *rest: (None, (len(draws), *rest)))
    monkeypatch.setattr(catalog.boosting, "trial_table", lambda spark, trials: trials)
    assert catalog.random_search(None, "sf") == (15, 3, ml.SEARCH_ROUNDS, ml.PATIENCE)
    default = catalog.boosting.BoostParams()
    assert (catalog.MODEL.rounds, catalog.MODEL.num_leaves, catalog.MODEL.max_depth) == (ml.FINAL_ROUNDS, default.num_leaves, default.max_depth)
