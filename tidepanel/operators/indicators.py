"""Technical indicators per code. The price is the adjusted close; high and low are unadjusted.

Each is a list of column levels (or a smoothing recipe), so that a run over many of them can share windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.ewm import Ewm, Smoothing, smooth, span
from tidepanel.functions.num import clip, div_ieee, fill, lit, ratio
from tidepanel.functions.windows import Stages, diff, entity, feature, lag, last_rows, moments, roll, so_far

PX, HIGH, LOW, VOL = "adj_close", "high", "low", "volume"
TREND_DAYS = (5, 10, 20, 60, 120, 240)
# Frames up to this length are aggregated directly; longer ones use running sums.
DIRECT_ROWS = 20


def rsi_recipe() -> Smoothing:
    d = diff(F.col(PX))
    specs, out = [], {}
    for w in TREND_DAYS:
        specs += [Ewm(f"__g{w}", "__gain", 1 / w), Ewm(f"__l{w}", "__loss", 1 / w)]
        value = lit(100) - lit(100) / (lit(1) + ratio(F.col(f"__g{w}"), F.col(f"__l{w}")))
        out[f"RSI_{w}"] = fill(F.when(F.col("__nth") > w, value), -1)
    before = {"__gain": clip(d, low=0), "__loss": -clip(d, high=0), "__nth": F.row_number().over(entity())}
    return Smoothing(before, specs, {}, [], [out])


def ema_recipe() -> Smoothing:
    specs = [Ewm(f"__e{w}", PX, span(w)) for w in TREND_DAYS]
    return Smoothing({}, specs, {}, [], [{f"EMA_{w}": F.coalesce(F.col(f"__e{w}"), F.col(PX)) for w in TREND_DAYS}])


def macd_recipe(fast: int = 12, slow: int = 26, signal: int = 9) -> Smoothing:
    line, sig = F.col("__line"), F.col("__signal")
    return Smoothing(
        {},
        [Ewm("__fast", PX, span(fast)), Ewm("__slow", PX, span(slow))],
        {"__line": F.col("__fast") - F.col("__slow")},
        [Ewm("__signal", "__line", span(signal))],
        [{"MACD": fill(line, 0), "MACD_Signal": fill(sig, 0), "MACD_Hist": fill(line - sig, 0)}],
    )


def kd_recipe(w: int = 9) -> Smoothing:
    low, high = roll(F.min, w, w, F.col(LOW)), roll(F.max, w, w, F.col(HIGH))
    return Smoothing(
        {"__rsv": lit(100) * (F.col(PX) - low) / (high - low + lit(1e-9))},
        [Ewm("__k", "__rsv", 1 / 3, seed=50.0)],
        {},
        [Ewm("__d", "__k", 1 / 3, seed=50.0)],
        [{"K": fill(F.col("__k"), 50), "D": fill(F.col("__d"), 50)}, {"KD_Diff": F.col("K") - F.col("D")}],
    )


def atr_recipe() -> Smoothing:
    prev, high, low = lag(F.col(PX)), F.col(HIGH), F.col(LOW)
    out = {}
    for w in (14, 28):
        value = F.col(f"__atr{w}")
        out[f"ATR_{w}"] = fill(value, 0)
        out[f"ATR_{w}_Pct"] = fill(ratio(value, F.col(PX)) * 100, 0)
    # greatest() skips nulls, so the first row is high - low.
    tr = F.greatest(high - low, F.abs(high - prev), F.abs(low - prev))
    return Smoothing({"__tr": tr}, [Ewm(f"__atr{w}", "__tr", span(w)) for w in (14, 28)], {}, [], [out])


def rsi(df: DataFrame) -> DataFrame:
    return smooth(df, rsi_recipe())


def ema(df: DataFrame) -> DataFrame:
    return smooth(df, ema_recipe())


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    return smooth(df, macd_recipe(fast, slow, signal))


def kd(df: DataFrame, w: int = 9) -> DataFrame:
    return smooth(df, kd_recipe(w))


def atr(df: DataFrame) -> DataFrame:
    return smooth(df, atr_recipe())


@feature
def sma(cols: set[str]) -> Stages:
    x = F.col(PX)
    long = [w for w in TREND_DAYS if w > DIRECT_ROWS]
    # Shifted by the code's first price, so that long running sums keep their digits.
    base = {"__base": F.first(x, ignorenulls=True).over(so_far())}
    sums = moments("sma", {"x": x - F.col("__base")}, long)
    raw = {}
    for w in TREND_DAYS:
        if w in long:
            mean = F.when(F.col(f"__sma_n_x_{w}") >= w, F.col(f"__sma_s_x_{w}") / w + F.col("__base"))
        else:
            mean = roll(F.avg, w, w, x)
        raw[f"SMA_{w}"] = F.coalesce(mean, x)
    ratios = {f"Price_SMA{w}_Ratio": fill((ratio(x, F.col(f"SMA_{w}")) - 1) * 100, 0) for w in TREND_DAYS}
    return [base, *sums, raw, ratios]


@feature
def williams_r(cols: set[str]) -> Stages:
    out = {}
    for w in (14, 28):
        high, low = roll(F.max, w, w, F.col(HIGH)), roll(F.min, w, w, F.col(LOW))
        out[f"Williams_R_{w}"] = fill(lit(-100) * (high - F.col(PX)) / (high - low + lit(1e-9)), -50)
    return [out]


@feature
def roc_momentum(cols: set[str]) -> Stages:
    out, x = {}, F.col(PX)
    for w in (5, 10, 20):
        old = lag(x, w)
        out[f"ROC_{w}"] = fill(lit(100) * (x - old) / (old + lit(1e-9)), 0)
        out[f"Momentum_{w}"] = fill(x - old, 0)
    return [out]


@feature
def bollinger(cols: set[str], w: int = 20, width: float = 2.0) -> Stages:
    x, mid, std = F.col(PX), F.col("__mid"), F.col("__std")
    upper, lower = mid + lit(width) * std, mid - lit(width) * std
    return [
        {"__mid": roll(F.avg, w, w, x), "__std": roll(F.stddev_samp, w, w, x)},
        {
            f"BB_Upper_{w}": fill(upper, 0),
            f"BB_Middle_{w}": fill(mid, 0),
            f"BB_Lower_{w}": fill(lower, 0),
            f"BB_PctB_{w}": fill((x - lower) / (upper - lower + lit(1e-9)), 0),
        },
    ]


@feature
def obv(cols: set[str]) -> Stages:
    step = fill(F.signum(diff(F.col(PX))) * F.col(VOL), 0)
    # Infinite when the earlier balance is zero; the feature matrix maps that to 0.
    roc = fill((div_ieee(F.col("OBV"), lag(F.col("OBV"), 5)) - 1) * 100, 0)
    return [{"__step": step}, {"OBV": F.sum("__step").over(so_far())}, {"OBV_ROC": roc}]


def _typical() -> Column:
    return (F.col(HIGH) + F.col(LOW) + F.col(PX)) / lit(3)


@feature
def vwap(cols: set[str]) -> Stages:
    tp, v = _typical(), F.col(VOL)
    mean = fill(ratio(F.sum(tp * v).over(so_far()), F.sum(v).over(so_far())), 0)
    return [{"VWAP": mean}, {"Price_VWAP_Ratio": (ratio(F.col(PX), F.col("VWAP")) - 1) * 100}]


@feature
def volume_ratio(cols: set[str]) -> Stages:
    out, v = {}, F.col(VOL)
    for w in (5, 20):
        mean = F.avg(v).over(last_rows(w))
        out[f"Volume_SMA_{w}"] = fill(mean, 0)
        out[f"Volume_Ratio_{w}"] = fill(ratio(v, mean), 0)
    return [out]


def _distance(center: Column):
    return lambda acc, v: acc + F.abs(v - center)


@feature
def cci(cols: set[str]) -> Stages:
    tp, stage, out = _typical(), {}, {}
    for w in (14, 20):
        stage[f"__mean{w}"] = roll(F.avg, w, w, tp)
        stage[f"__vals{w}"] = F.collect_list(tp).over(last_rows(w))
        mean = F.col(f"__mean{w}")
        mad = F.aggregate(F.col(f"__vals{w}"), lit(0), _distance(mean)) / w
        out[f"CCI_{w}"] = fill((tp - mean) / (lit(0.015) * mad + lit(1e-9)), 0)
    return [stage, out]
