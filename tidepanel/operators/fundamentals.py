"""Revenue, earnings, valuation and short-selling features per code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.num import clip, div_ieee, fill, lit, ratio, safe_div
from tidepanel.functions.ordered import average_rank
from tidepanel.functions.windows import (
    CODE,
    DATE,
    Stages,
    before,
    diff,
    drop_private,
    feature,
    ffill,
    lag,
    moments,
    roll,
)
from tidepanel.operators.flow import has

QUARTER_ROWS, YEAR_ROWS = 63, 252


@feature
def fundamental_basic(cols: set[str]) -> Stages:
    out, c = {}, F.col
    if has(cols, "monthly_revenue_ly_cum"):
        out["rev_ly_cum_k"] = fill(c("monthly_revenue_ly_cum") / 1000, 0)
    if has(cols, "monthly_revenue_mom"):
        out["rev_mom"] = fill(c("monthly_revenue_mom"), 0)
    if has(cols, "monthly_revenue", "fii_shares"):
        out["rev_per_share"] = fill(ratio(c("monthly_revenue"), c("fii_shares")), 0)
    if has(cols, "eps"):
        out["eps_f"] = fill(c("eps"), 0)
    return [out]


def _growth(now: Column, then: Column) -> Column:
    return clip(ratio(now, F.abs(then)) - 1, -2, 10)


@feature
def revenue_growth(cols: set[str]) -> Stages:
    """Rolling 3- and 12-month revenue against the same sum one frame earlier."""
    if not has(cols, "monthly_revenue"):
        return []
    sums = moments("rev", {"rev": F.col("monthly_revenue")}, [QUARTER_ROWS, YEAR_ROWS])
    total = {"__known": F.count("monthly_revenue").over(Window.partitionBy(CODE))}
    out = {}
    for o, w in (("rev_chg_63", QUARTER_ROWS), ("rev_chg_252", YEAR_ROWS)):
        total[f"__r{w}"] = F.when(F.col(f"__rev_n_rev_{w}") >= w // 2, F.col(f"__rev_s_rev_{w}"))
        r = F.col(f"__r{w}")
        out[o] = fill(F.when(F.col("__known") >= QUARTER_ROWS, _growth(r, lag(r, w))), 0)
    return [*sums, total, out]


@feature
def revenue_hist_low(cols: set[str]) -> Stages:
    if not has(cols, "monthly_revenue"):
        return []
    rev = F.col("monthly_revenue")
    lowest = F.min(rev).over(before())
    return [{"rev_vs_hist_low": fill(clip(ratio(rev, F.abs(lowest)) - 1, 0, 100), 0)}]


@feature
def eps_ttm(cols: set[str]) -> Stages:
    """Trailing-year sums of figures that count from the day after their row."""
    have = [c for c in ("eps", "pretax_profit") if has(cols, c)]
    later = {f"__lag_{c}": lag(F.col(c)) for c in have}
    known = {f"__known_{c}": ffill(F.col(f"__lag_{c}")) for c in have}
    sums = moments("ttm", {c: F.col(f"__known_{c}") for c in have}, [YEAR_ROWS])
    ttm = {
        f"__ttm_{c}": F.when(F.col(f"__ttm_n_{c}_{YEAR_ROWS}") >= QUARTER_ROWS, F.col(f"__ttm_s_{c}_{YEAR_ROWS}"))
        for c in have
    }
    out = {}
    if "eps" in have:
        t = F.col("__ttm_eps")
        out["eps_ttm"] = fill(t, 0)
        out["eps_ttm_yoy"] = fill(_growth(t, lag(t, YEAR_ROWS)), 0)
    if "pretax_profit" in have:
        out["pretax_prev_year"] = fill(lag(F.col("__ttm_pretax_profit"), YEAR_ROWS), 0)
    return [later, known, *sums, ttm, out]


@feature
def valuation(cols: set[str]) -> Stages:
    out = {}
    if has(cols, "market_value", "monthly_revenue_ly_cum"):
        ps = safe_div(F.col("market_value"), F.col("monthly_revenue_ly_cum"))
        out["price_to_sales"] = fill(clip(ps, 0, 200), 0)
    if has(cols, "equity"):
        out["equity_k"] = fill(F.col("equity") / 1000, 0)
    return [out]


@feature
def short_basic(cols: set[str], log_transform: bool = True) -> Stages:
    out, c = {}, F.col
    if has(cols, "ms_balance", "volume"):
        out["short_sell_volume_ratio"] = fill(clip(ratio(c("ms_balance"), c("volume")), 0, 1), 0)
    if has(cols, "ms_balance", "ms_limit"):
        out["short_headroom"] = fill(clip(lit(1) - ratio(c("ms_balance"), c("ms_limit")), 0, 1), 1)
        out["headroom_log"] = fill(F.log1p(clip(c("ms_limit") - c("ms_balance"), low=0)), 0)
    if has(cols, "sl_sell_balance", "sl_balance"):
        out["inst_retail_ratio"] = fill(clip(ratio(c("sl_sell_balance"), c("sl_balance")), 0, 1), 0)
    if has(cols, "sl_sell_balance"):
        out["short_net_flow_sec"] = fill(diff(c("sl_sell_balance")), 0)
    if log_transform:
        for x in ("sl_sell_balance", "sl_balance", "ms_balance"):
            if has(cols, x):
                out[f"{x}_log"] = fill(F.log1p(clip(c(x), low=0)), 0)
    return [out]


@feature
def days_to_cover(cols: set[str]) -> Stages:
    if not has(cols, "sl_sell_balance", "volume"):
        return []
    usual = F.coalesce(roll(F.avg, 20, 5, F.col("volume")), F.col("volume"))
    return [{"days_to_cover": fill(clip(ratio(F.col("sl_sell_balance"), usual), 0, 250), 0)}]


def days_to_cover_rank(df: DataFrame, task_rows: int | None = None) -> DataFrame:
    """Percentile of days_to_cover among the day's names; ties share the average rank."""
    df = average_rank(df, [DATE], "days_to_cover", "__avg", task_rows=task_rows)
    return drop_private(df.withColumn("days_to_cover_rank", fill(F.col("__avg") / F.col("__avg_n"), 0.5)))


@feature
def short_change(cols: set[str], windows: tuple[int, ...] = (5, 10, 20)) -> Stages:
    if not has(cols, "sl_sell_balance"):
        return []
    x = F.col("sl_sell_balance")
    return [{f"short_balance_chg_{w}d": fill(clip(div_ieee(x, lag(x, w)) - 1, -2, 2), 0) for w in windows}]
