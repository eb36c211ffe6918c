import datetime as dt
import math
import random

import pandas as pd
import pytest
from panel_helpers import column
from pyspark.sql import functions as F

from tidepanel.functions import ordered
from tidepanel.functions.ewm import Ewm, ewm, span
from tidepanel.functions.num import canon, clip, div_ieee, safe_div, signed_log1p
from tidepanel.functions.windows import cumsum_in, first_in, moments, roll, run_stages, run_sums


def test_run_sum_restarts_on_sign_change(series):
    df = series({"a": [{"v": v} for v in (500, 300, -200, -400, 100)]})
    assert column(run_stages(df, run_sums({"r": "v"})), "r") == [500, 800, -200, -600, 100]


def test_run_sum_zero_continues_and_null_is_skipped(series):
    df = series({"a": [{"v": v} for v in (0, 5, 0, None, 2, -1, 0, None, -3, 4)]})
    assert column(run_stages(df, run_sums({"r": "v"})), "r") == [0, 5, 5, None, 7, -1, -1, None, -4, 4]


def test_ewm_short(series):
    df = ewm(series({"a": [{"x": None}, {"x": 1}, {"x": 2}, {"x": 5}]}), [Ewm("y", "x", 1 / 3)])
    got = column(df, "y")
    assert got[0] is None
    assert got[1:] == pytest.approx([1, 4 / 3, 23 / 9])


@pytest.mark.parametrize("alpha", [span(5), span(240), 1 / 3, 0.9])
def test_ewm_equals_loop_across_blocks(series, alpha):
    rng = random.Random(1)
    xs = [rng.uniform(-5, 5) for _ in range(1500)]
    want, y = [], None
    for x in xs:
        y = x if y is None else (1 - alpha) * y + alpha * x
        want.append(y)
    got = column(ewm(series({"a": [{"x": x} for x in xs]}), [Ewm("y", "x", alpha)]), "y")
    assert got == pytest.approx(want, rel=1e-11, abs=1e-12)


@pytest.mark.parametrize("alpha", [1 / 3, span(60), 0.9])
def test_ewm_over_gaps_equals_data_frames(series, alpha):
    rng = random.Random(2)
    xs = [None if rng.random() < 0.3 or 40 < i < 90 else rng.uniform(1, 5) for i in range(900)]
    got = column(ewm(series({"a": [{"x": x} for x in xs]}), [Ewm("y", "x", alpha)]), "y")
    want = pd.Series(xs, dtype=float).ewm(alpha=alpha, adjust=False).mean()
    assert [v is None for v in got] == want.isna().tolist()
    assert [v for v in got if v is not None] == pytest.approx(want.dropna().tolist(), rel=1e-10)


def test_seeded_mean_passes_over_gaps(series):
    rows = [{"x": x} for x in (None, 80, None, None, 20)]
    got = column(ewm(series({"a": rows}), [Ewm("k", "x", 1 / 3, seed=50.0)]), "k")
    assert got[0] is got[2] is got[3] is None
    assert [got[1], got[4]] == pytest.approx([60, 60 * 2 / 3 + 20 / 3])


def test_ewm_seed(series):
    df = ewm(series({"a": [{"x": None}, {"x": 80}, {"x": 20}]}), [Ewm("k", "x", 1 / 3, seed=50.0)])
    assert column(df, "k")[1:] == pytest.approx([60, 60 * 2 / 3 + 20 / 3])


def test_division_rules(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 3.0), (1.0, None)], "a DOUBLE, b DOUBLE")
    got = [tuple(r) for r in df.select(div_ieee(F.col("a"), F.col("b")), safe_div(F.col("a"), F.col("b"))).collect()]
    assert got == [(math.inf, None), (-math.inf, None), (None, None), (2.0, 2.0), (None, None)]


def test_clip_keeps_null_and_canon_has_no_negative_zero(spark):
    df = spark.createDataFrame([(None,), (-3.0,), (9.0,)], "x DOUBLE")
    assert [r[0] for r in df.select(clip(F.col("x"), -1, 1)).collect()] == [None, -1.0, 1.0]
    z = spark.range(1).select(canon(F.lit(-1e-9)).alias("z")).first()["z"]
    assert math.copysign(1, z) == 1


def test_signed_log1p(spark):
    got = [r[0] for r in spark.createDataFrame([(-1.0,), (0.0,), (1.0,)], "x DOUBLE").select(signed_log1p(F.col("x"))).collect()]
    assert got == pytest.approx([-math.log(2), 0, math.log(2)])


def test_roll_needs_enough_values(series):
    df = series({"a": [{"x": 1}, {"x": None}, {"x": 3}, {"x": 5}]})
    assert column(df.withColumn("y", roll(F.avg, 3, 2, F.col("x"))), "y") == [None, None, 2, 4]


def test_moments_equal_sliding_frames(series):
    rng = random.Random(2)
    data = {c: [{"x": None if rng.random() < 0.2 else rng.uniform(-9, 9)} for _ in range(60)] for c in "ab"}
    data["a"][7]["x"] = math.inf
    df = series(data)
    df = run_stages(df, [*moments("t", {"x": F.col("x")}, [7]), {"s": F.col("__t_s_x_7"), "n": F.col("__t_n_x_7")}])
    rows = df.orderBy("code", "date").collect()
    for i, r in enumerate(rows):
        frame = [data[r["code"]][j]["x"] for j in range(max(0, i % 60 - 6), i % 60 + 1)]
        frame = [x for x in frame if x is not None and math.isfinite(x)]
        assert r["n"] == len(frame)
        assert r["s"] == pytest.approx(sum(frame), abs=1e-9)


def test_period_edges(series):
    days = [dt.date(2019, 12, 29), dt.date(2019, 12, 30), dt.date(2020, 1, 1), dt.date(2020, 3, 31), dt.date(2020, 4, 1)]
    df = series({"a": [{"x": i + 1.0, "date": d} for i, d in enumerate(days)]})
    df = df.withColumns({u: first_in(F.col("x"), u) for u in ("week", "month", "quarter", "year")})
    df = df.withColumn("c", cumsum_in(F.col("x"), "year"))
    assert column(df, "week") == [1, 2, 2, 4, 4]
    assert column(df, "month") == [1, 1, 3, 4, 5]
    assert column(df, "quarter") == [1, 1, 3, 3, 5]
    assert column(df, "year") == [1, 1, 3, 3, 3]
    assert column(df, "c") == [1, 3, 3, 7, 12]


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows; many ties."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.8 else f"g{i % 3}", i, float(rng.randint(0, 15))) for i in range(3000)]
    return spark.createDataFrame(rows, "g STRING, id INT, v DOUBLE")


def test_running_sum_is_the_same_when_a_group_is_split(skewed, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 200)
    order = [F.col("v").desc(), F.col("id")]
    a = ordered.ordered_running_sum(skewed, ["g"], order, {"r": F.lit(1)}, {"n": "r"})
    b = ordered.ordered_running_sum(skewed, ["g"], order, {"r": F.lit(1)}, {"n": "r"}, task_rows=0)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))


def test_average_rank_is_the_same_when_a_group_is_split(skewed, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 5)
    a = ordered.average_rank(skewed, ["g"], "v", "r", descending=True)
    for task_rows in (0, 150):  # all values count as hot; the hot group's values are hot, others are not
        b = ordered.average_rank(skewed, ["g"], "v", "r", descending=True, task_rows=task_rows)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))
    pdf = pd.DataFrame(a.collect(), columns=a.columns)
    want = pdf.groupby("g")["v"].rank(ascending=False, method="average")
    assert pdf["r"].tolist() == want.tolist()


@pytest.mark.parametrize("p", [0.5, 0.25, 0.9])
def test_exact_quantile(skewed, monkeypatch, p):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 5)
    want = skewed.toPandas().groupby("g")["v"].quantile(p).to_dict()
    for task_rows in (None, 0):
        got = {r["g"]: r["q"] for r in ordered.exact_quantile(skewed, ["g"], "v", p, "q", task_rows).collect()}
        assert got == pytest.approx(want)


@pytest.mark.parametrize("lengths", [[63, 252], [7, 60, 125]])
def test_moments_forget_a_spike(series, lengths):
    rng = random.Random(5)
    xs = [None if rng.random() < 0.1 else rng.uniform(-1, 1) for _ in range(700)]
    xs[40], xs[300] = 1e12, -3e15
    df = series({"a": [{"x": x} for x in xs], "b": [{"x": 1.0}]})
    names = {f"s{w}": F.col(f"__t_s_x_{w}") for w in lengths} | {f"n{w}": F.col(f"__t_n_x_{w}") for w in lengths}
    rows = run_stages(df, [*moments("t", {"x": F.col("x")}, lengths), names]).filter("code = 'a'").orderBy("date").collect()
    for i, r in enumerate(rows):
        for w in lengths:
            frame = [x for x in xs[max(0, i - w + 1) : i + 1] if x is not None]
            assert r[f"n{w}"] == len(frame)
            assert r[f"s{w}"] == pytest.approx(math.fsum(frame), rel=1e-9, abs=1e-9)


@pytest.fixture(scope="module")
def rough(spark):
    """Groups of many distinct values: even, heavy-tailed, with infinite values, of one value, and a null group."""
    rng = random.Random(7)
    rows = [("even", rng.uniform(-1, 1)) for _ in range(3001)]
    rows += [("tail", math.exp(rng.uniform(-600, 600))) for _ in range(3000)]
    rows += [("wide", rng.choice([-1.7e308, 1.7e308, rng.random()])) for _ in range(2000)]
    rows += [("inf", rng.choice([-math.inf, math.inf, rng.random()])) for _ in range(2000)]
    rows += [("same", 4.0)] * 2000 + [(None, float(i)) for i in range(2000)] + [("few", 1.0), ("few", 2.0), ("few", None)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g STRING, v DOUBLE")


@pytest.mark.parametrize("passes", [1, 3])
@pytest.mark.parametrize("p", [0.5, 0.9])
def test_quantile_by_narrowing(rough, monkeypatch, passes, p):
    monkeypatch.setattr(ordered, "BINS", 8)
    monkeypatch.setattr(ordered, "PASSES", passes)
    groups = {}
    for g, v in rough.filter("v IS NOT NULL").collect():
        groups.setdefault(g, []).append(v)
    got = {r["g"]: r["q"] for r in ordered.exact_quantile(rough, ["g"], "v", p, "q", task_rows=500).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        vs.sort()
        at = p * (len(vs) - 1)
        lo, hi = vs[math.floor(at)], vs[math.ceil(at)]
        assert got[g] == lo or got[g] == pytest.approx(lo + (hi - lo) * (at - math.floor(at)), rel=1e-12), g
    whole = ordered.exact_quantile(rough.filter("g = 'even'"), [], "v", p, "q", task_rows=500)
    assert whole.columns == ["q"]
    assert [r["q"] for r in whole.collect()] == pytest.approx([got["even"]])


def test_narrowing_shuffles_bins_not_values(rough, monkeypatch):
    """One pass of 8 bins leaves about an eighth of an even group to go by value."""
    monkeypatch.setattr(ordered, "BINS", 8)
    monkeypatch.setattr(ordered, "PASSES", 1)
    seen = []
    plain = ordered._by_value
    monkeypatch.setattr(ordered, "_by_value", lambda df, *a: seen.append(df.count()) or plain(df, *a))
    ordered.exact_quantile(rough.filter("g = 'even'"), ["g"], "v", 0.5, "q", task_rows=500).collect()
    assert len(seen) == 1 and 0 < seen[0] < 600


def test_quantile_of_nothing(rough):
    assert ordered.exact_quantile(rough.filter("false"), ["g"], "v", 0.5, "q").collect() == []
    assert ordered.exact_quantile(rough.filter("v IS NULL"), [], "v", 0.5, "q", task_rows=0).collect() == []
