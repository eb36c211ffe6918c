"""Price-derived, return, and investor-flow features per code.

Every group of outputs is emitted only when its inputs are present.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepanel.functions.num import clip, div_ieee, fill, lit, ratio
from tidepanel.functions.windows import (
    Stages,
    cumsum_in,
    diff,
    feature,
    first_in,
    lag,
    last_rows,
    rolling_beta,
    run_sums,
    to_date_in,
)

PX = "adj_close"


def has(cols: set[str], *names: str) -> bool:
    return cols.issuperset(names)


@feature
def price_derived(cols: set[str]) -> Stages:
    out, c = {}, F.col
    if has(cols, "high", "low", "close"):
        out["hl_spread"] = clip(ratio(c("high") - c("low"), c("close")), 0, 1)
    if has(cols, "volume", "fii_shares", "insider_shares"):
        floating = clip(c("fii_shares") - c("insider_shares"), low=1)
        out["float_turnover"] = fill(clip(c("volume") / floating * 100, 0, 100), 0)
    if has(cols, "volume", "intraday_shares"):
        out["cash_trade_share"] = fill(clip(ratio(c("volume") - c("intraday_shares"), c("volume")), 0, 1), 0)
    if has(cols, "intraday_sell_pct"):
        out["intraday_sell_share"] = fill(c("intraday_sell_pct"), 0)
    if has(cols, "close"):
        out["close_chg"] = fill(diff(c("close")), 0)
    return [out]


@feature
def momentum_ext(cols: set[str]) -> Stages:
    x = F.col(PX)
    out = {"log_return": fill(F.ln(div_ieee(x, lag(x)) + lit(1e-9)), 0)}
    for w in (21, 63, 252):
        out[f"ret_{w}"] = fill(clip(div_ieee(x, lag(x, w)) - 1, -0.99, 10), 0)
    return [out, {"ret_21_pct": F.col("ret_21") * 100}]


@feature
def period_to_date_returns(cols: set[str]) -> Stages:
    x = F.col(PX)
    units = {"ret_mtd": "month", "ret_wtd": "week", "ret_ytd": "year", "ret_qtd": "quarter"}
    return [{o: fill(ratio(x, first_in(x, unit)) - 1, 0) for o, unit in units.items()}]


@feature
def capm_betas(cols: set[str]) -> Stages:
    specs = {"capm_beta_21": (21, 10), "capm_beta_189": (189, 60), "capm_beta_252": (252, 90)}
    raw = rolling_beta("capm", "daily_return", "market_return", {f"__{o}": s for o, s in specs.items()})
    return [*raw, {o: fill(clip(F.col(f"__{o}"), -5, 5), 1) for o in specs}]


def _net() -> Column:
    return F.col("fii_net") + F.col("dealer_net") + F.col("trust_net")


@feature
def flow_basic(cols: set[str]) -> Stages:
    out, c = {}, F.col
    nets = has(cols, "fii_net", "dealer_net", "trust_net")
    if nets and has(cols, "close"):
        out["inst_net_amt_k"] = fill(_net() * c("close") / 1000, 0)
    if has(cols, "trust_net", "close"):
        out["trust_net_amt_m"] = fill(c("trust_net") * c("close") / 1e6, 0)
    if has(cols, "margin_buy", "margin_sell"):
        out["margin_turnover"] = fill(c("margin_buy") + c("margin_sell"), 0)
    if has(cols, "margin_buy", "close"):
        out["margin_buy_amt_k"] = fill(c("margin_buy") * c("close"), 0)
    if has(cols, "margin_util"):
        out["margin_util_f"] = fill(c("margin_util"), 0)
    if has(cols, "margin_balance", "close"):
        out["margin_chg_amt_k"] = fill(diff(c("margin_balance")) * c("close") / 1000, 0)
    if has(cols, "margin_balance", "ms_balance", "close"):
        long = clip(c("margin_balance"), low=0) * c("close")
        short = clip(c("ms_balance"), low=0) * c("close")
        kept = (long + short * 1.9) / (long * 0.6 + short + lit(1e-9)) * 100
        out["maintenance_ratio"] = fill(clip(kept, 0, 500), 130)
    if has(cols, "margin_buy", "margin_sell", "ms_balance", "volume"):
        credit = c("margin_buy") + c("margin_sell") + c("ms_balance")
        out["credit_share"] = fill(clip(ratio(credit, c("volume")), 0, 1), 0)
    if has(cols, "fii_investable"):
        out["foreign_investable"] = fill(c("fii_investable"), 0)
    if has(cols, "insider_shares"):
        out["insider_shares_k"] = fill(c("insider_shares") / 1000, 0)
    if nets:
        out["inst_buy"] = fill(clip(_net(), low=0), 0)
        out["inst_sell"] = fill(clip(-_net(), low=0), 0)
    if has(cols, "pbr"):
        out["pbr_f"] = fill(c("pbr"), 0)
    if has(cols, "margin_buy"):
        out["margin_buy_f"] = fill(c("margin_buy"), 0)
    if has(cols, "fii_net"):
        out["foreign_sell"] = fill(clip(-c("fii_net"), low=0), 0)
    if has(cols, "trust_net", "volume"):
        out["trust_share"] = fill(clip(ratio(F.abs(c("trust_net")), c("volume")), 0, 1), 0)
    return [out]


@feature
def flow_runs(cols: set[str]) -> Stages:
    pairs = {"dealer_run_k": "dealer_net", "foreign_run_k": "fii_net"}
    have = {o: x for o, x in pairs.items() if has(cols, x)}
    return [*run_sums({f"__{o}": x for o, x in have.items()}), {o: fill(F.col(f"__{o}") / 1000, 0) for o in have}]


@feature
def flow_period_to_date(cols: set[str]) -> Stages:
    work, out = {}, {}
    if has(cols, "dealer_net"):
        out["dealer_net_wtd"] = F.col("dealer_net")
        for o, unit in (("dealer_wtd_k", "week"), ("dealer_mtd_k", "month"), ("dealer_ytd_k", "year")):
            out[o] = fill(cumsum_in(F.col("dealer_net"), unit) / 1000, 0)
        out["dealer_mtd_k2"] = out["dealer_mtd_k"]
    if has(cols, "fii_net"):
        for o, unit in (("foreign_wtd_k", "week"), ("foreign_ytd_k", "year")):
            out[o] = fill(cumsum_in(F.col("fii_net"), unit) / 1000, 0)
    if has(cols, "fii_net", "dealer_net", "trust_net", "close"):
        work["__amt"] = _net() * F.col("close")
        for o, unit in (("inst_amt_mtd_k", "month"), ("inst_amt_wtd_k", "week")):
            out[o] = fill(cumsum_in(F.col("__amt"), unit) / 1000, 0)
    if has(cols, "dealer_net", "close"):
        work["__dealer_amt"] = F.col("dealer_net") * F.col("close")
        out["dealer_amt_wtd_k"] = fill(cumsum_in(F.col("__dealer_amt"), "week") / 1000, 0)
    return [work, out]


@feature
def flow_buy_days(cols: set[str]) -> Stages:
    if not has(cols, "fii_net", "dealer_net", "trust_net"):
        return []
    return [{"inst_buy_days_20": F.sum(F.when(_net() > 0, lit(1)).otherwise(lit(0))).over(last_rows(20))}]


@feature
def excess_features(cols: set[str]) -> Stages:
    """Daily and week-to-date returns in excess of the market, both up to the row only."""
    x = F.col(PX)
    ret = fill(clip(div_ieee(x, lag(x)) - 1, -0.5, 0.5), 0)
    growth = F.product(lit(1) + F.col("market_return")).over(to_date_in("week"))
    return [
        {"ret_1d": ret, "__own_wtd": ratio(x, first_in(x, "week")) - 1, "__mkt_wtd": growth - 1},
        {
            "excess_1d": fill(F.col("ret_1d") - F.col("market_return"), 0),
            "excess_wtd": fill(F.col("__own_wtd") - F.col("__mkt_wtd"), 0),
        },
    ]
