"""Own feature steps: order, errors, and one exchange for all."""

import pytest
from pyspark.sql import functions as F

from tidepanel.functions.windows import by_code, lag, roll
from tidepanel.plans.preprocess import PanelConfig, per_code_features
from tidepanel.plans.steps import Step, in_order, run_steps


def step(name, reads, makes, stages=lambda: []):
    """Expressions are made when the step runs; there is no session before."""
    return Step(name, tuple(reads), tuple(makes), lambda cols, cfg: stages())


def one(name):
    return lambda: [{name: F.lit(1)}]


A = step("a", ["x"], ["a"], lambda: [{"__was": lag(F.col("x"))}, {"a": F.col("x") - F.col("__was")}])
B = step("b", ["a"], ["b"], lambda: [{"b": roll(F.sum, 2, 1, F.col("a"))}])
C = step("c", ["b", "x"], ["c"], lambda: [{"c": F.col("b") + F.col("x")}])


def test_order_follows_the_reads():
    assert [s.name for s in in_order((C, B, A), ["x"])] == ["a", "b", "c"]
    assert in_order((), []) == []


@pytest.mark.parametrize(
    "steps, error",
    [
        ((A, step("b", ["x"], ["a"], one("a"))), "both make"),
        ((A, A), "two steps"),
        ((step("x", ["code"], ["x"], one("x")),), "there already"),
        ((B,), "lacks"),
        ((step("p", ["q"], ["p"]), step("q", ["p"], ["q"])), "cycle"),
        ((step("s", ["s"], ["s"]),), "cycle"),
        ((step("u", ["x"], ["u"], one("v")),), "declares"),
        ((A, step("d", ["x"], ["d"], lambda: [{"__was": F.lit(1)}, {"d": F.col("__was")}])), "both use"),
    ],
)
def test_what_does_not_fit_is_refused(series, steps, error):
    with pytest.raises((ValueError, RuntimeError), match=error):
        run_steps(series({"a": [{"x": 1}]}), steps)


def test_a_step_reads_what_another_makes(series):
    df = series({"k": [{"x": v, "y": v} for v in (1, 4, 9, 16)], "l": [{"x": 5, "y": None}]})
    got = run_steps(by_code(df), (C, B, A)).orderBy("code", "date")
    assert got.columns == ["code", "date", "x", "a", "b", "c", "y"]
    assert [(r.a, r.b, r.c, r.y) for r in got.collect()] == [(None, None, None, 1), (3, 3, 7, 4), (5, 8, 17, 9), (7, 12, 28, 16), (None, None, None, None)]
    assert run_steps(df, ()) is df


def test_absent_optional_reads(series):
    maybe = Step("m", ("x",), ("m",), lambda cols, cfg: [{"m": F.col("x") + F.col("z")}] if "z" in cols else [], ("z",))
    df = series({"a": [{"x": 1}]})
    assert run_steps(df, (maybe,)).columns == ["code", "date", "x"]
    assert run_steps(df.withColumn("z", F.lit(2.0)), (maybe,)).first().m == 3


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_steps_run_on_the_exchange_of_the_features(series):
    rows = [{c: 10.0 + i for c in ("high", "low", "close", "adj_close", "adj_open", "volume", "market_return", "x")} for i in range(5)]
    df = series({"k": rows})
    plain = plan_of(per_code_features(df, PanelConfig()))
    builtin = step("r", ["daily_return"], ["r"], lambda: [{"r": roll(F.sum, 3, 1, F.col("daily_return"))}])
    own = per_code_features(df, PanelConfig(steps=(builtin, C, B, A)))
    assert {"r", "a", "b", "c"} <= set(own.columns)
    assert plan_of(own).count("Exchange") == plain.count("Exchange")
    assert plan_of(run_steps(by_code(df), (C, B, A))).count("Sort [") == 1
    assert own.count() == 5
