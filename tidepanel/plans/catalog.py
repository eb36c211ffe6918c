"""Registered queries: each runs one operator over the whole of the given tables."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.num import canon, lit, signed_log1p
from tidepanel.functions.windows import CODE, DATE, by_code, lag, roll
from tidepanel.operators import backtest as bt
from tidepanel.operators import beta, boosting, clean, crosssec, evaluate, flow, fundamentals, indicators, labels, market, ml
from tidepanel.plans.liquidity import LiquidityConfig, build_filtered, provenance
from tidepanel.plans.preprocess import Family, PanelConfig, build_features, clean_panel, preprocess, run_family
from tidepanel.plans.steps import Step, run_steps
from tidepanel.plans.walkforward import WalkForward, WalkForwardConfig
from tidepanel.sources import panel as src
from tidepanel.sources.naming import RAW_TO_PANEL
from tidepanel.sources.results import market_series_from_files, merge_predictions, read_predictions
from tidepanel.sources.scratch import shared, shared_path
from tidepanel.sources.trades import PANEL_COLUMNS, build_panel

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
# Outputs of each feature query; together they are the feature table.
STEP_COLUMNS: dict[str, list[str]] = {}

FIRST_YEAR, LAST_YEAR = 1995, 2001
TARGET = "excess_return_tick"
# Features that the panel profile counts, by the names of their steps.
PROFILE = {"indicators": ("ta_", "beta_vasicek", "capm_"), "short": ("short_",)}
# Wide amounts are compared to fewer digits: a double carries about 16.
COARSE = {
    "amount", "market_value", "equity", "monthly_revenue", "monthly_revenue_ly_cum", "pretax_profit",
    "rev_ly_cum_k", "margin_buy_amt_k",
}
# Rolling sums over a year of such amounts.
WHOLE = {"pretax_prev_year"}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def digits_of(name: str) -> int:
    return 0 if name in WHOLE else 2 if name in COARSE else 6


def out(df: DataFrame, cols: list[str], keys: tuple[str, ...] = (CODE, DATE)) -> DataFrame:
    """Keys plus columns, doubles in comparable form."""
    types = dict(df.dtypes)
    made: list[Column] = []
    for c in cols:
        made.append(canon(F.col(c), digits_of(c)).alias(c) if types[c] == "double" else F.col(c))
    return df.select(*keys, *made)


# --- shared inputs -------------------------------------------------------------------------------------------------


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, f"{sf}/panel", lambda: build_panel(spark, sf))


def market_panel(spark: SparkSession, sf: str) -> DataFrame:
    return market.add_market_returns(panel(spark, sf))


def panel_on_code(spark: SparkSession, sf: str) -> DataFrame:
    """The whole panel with the market's returns, partitioned on the code as it is made: neither written nor exchanged again."""
    return market.join_market_returns(build_panel(spark, sf), market_days(spark, sf))


# What the labels and the scores read of a panel; the other columns would only ride along.
PRICES = ["open", "close", "adj_open", "adj_close", "market_index"]


def prices(spark: SparkSession, sf: str) -> DataFrame:
    """Prices of the panel and the market's returns, partitioned on the code as the panel is made, so that they need neither a table nor an exchange."""
    return market.join_market_returns(build_panel(spark, sf).select(CODE, DATE, *PRICES), market_days(spark, sf))


def market_days(spark: SparkSession, sf: str) -> DataFrame:
    """Market returns, one row per day; no other column of the panel is made for them."""
    return shared(spark, f"{sf}/market_days", lambda: market.market_series(build_panel(spark, sf).select(CODE, DATE, "market_index")))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Prices, returns, betas and labels of every row; labelled_panel has them beside all columns of the panel."""

    def build() -> DataFrame:
        df = labels.forward_return(beta.daily_return_vol(prices(spark, sf)))
        return labels.label_returns(beta.shrunk_beta(df))

    return shared(spark, f"{sf}/labelled", build)


def labelled_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The whole panel with its labels, partitioned on the code; betas look across codes over the prices alone."""
    side = beta.daily_return_vol(prices(spark, sf).select(CODE, DATE, "adj_close", "market_return"))

    def add(narrow: DataFrame, _cols: set[str], _cfg: PanelConfig) -> DataFrame:
        return labels.add_labels(beta.shrunk_beta(beta.daily_return_vol(narrow), source=side))

    reads = ("adj_close", "adj_open", "market_return", "market_return_fwd")
    return run_family(panel_on_code(spark, sf), Family("labels", reads, reads, add), PanelConfig(FIRST_YEAR, LAST_YEAR))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Scores from the day's own move; the rows of one year appear under a later window as well."""

    def build() -> DataFrame:
        z = lit(10) * (F.col("close") - F.col("open")) / F.col("open")
        prob = F.round(lit(0.5) + lit(0.5) * z / (lit(1) + F.abs(z)), 6)
        base = labelled(spark, sf).select(CODE, DATE, "return", F.col(TARGET).alias("y_true"), prob.alias("y_prob"))
        base = base.withColumn("y_pred", (F.col("y_prob") >= 0.5).cast("int"))
        y = F.year(DATE)
        first = base.withColumn("window", F.format_string("%d_%d", y - 2, y))
        again = base.filter(y == LAST_YEAR - 1).withColumn("window", F.format_string("%d_%d", y - 1, y + 1))
        return first.unionByName(again)

    return shared(spark, f"{sf}/predictions", build)


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    return crosssec.assign_deciles(merge_predictions(predictions(spark, sf)))


def series_wide(spark: SparkSession, sf: str) -> DataFrame:
    """date, D1..D10, market, excess_D1: one row per day."""

    def build() -> DataFrame:
        bench = market_days(spark, sf)
        return bt.with_benchmark(bt.decile_table(bt.decile_daily_returns(ranked(spark, sf))), bench)

    return shared(spark, f"{sf}/series", build)


def series_pair(spark: SparkSession, sf: str) -> DataFrame:
    return series_wide(spark, sf).select(DATE, F.col("D1").alias("s"), F.col("market").alias("m"))


def feature_years(spark: SparkSession, sf: str) -> str:
    return shared_path(spark, f"{sf}/feature_years", lambda p: src.write_years(labelled_panel(spark, sf), p, on_code=True))


# --- sources and sinks ---------------------------------------------------------------------------------------------


@query
def panel_scan(spark, sf):
    """Yearly raw tables under feed names, read back over a range that includes absent years."""
    df = src.load_panel(spark, raw_years(spark, sf), FIRST_YEAR - 1, LAST_YEAR + 1)
    return out(df, [c for c in PANEL_COLUMNS if c not in (CODE, DATE)])


def messy(spark, sf) -> DataFrame:
    """Panel columns as text: one row in 7 of x, one in 2 of y does not read as a number; junk is almost empty."""
    v = F.col("volume").cast("bigint")
    k = v + F.dayofmonth(DATE)
    return panel(spark, sf).select(
        CODE,
        F.col(DATE).cast("string").alias(DATE),
        F.when(k % 7 == 0, "n/a").otherwise(v.cast("string")).alias("x"),
        F.when(k % 2 == 0, "bad").otherwise(v.cast("string")).alias("y"),
        F.when((v % 200 == 0) & (F.dayofmonth(DATE) % 2 == 0), "1").alias("junk"),
        F.col("volume"),
    )


@query
def panel_coerce(spark, sf):
    return out(src.coerce_types(messy(spark, sf)), ["x", "y", "junk", "volume"])


@query
def latest_date(spark, sf):
    return src.latest_date(spark, feature_years(spark, sf), FIRST_YEAR, LAST_YEAR + 3)


@query
def window_scan(spark, sf):
    """Every walk-forward window read on its own: rows with a target, positives and dates."""
    root, parts = feature_years(spark, sf), None
    for s, e in ml.walk_forward_windows(FIRST_YEAR, LAST_YEAR):
        df = src.window_scan(spark, root, s, TARGET).groupBy("year").agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(TARGET).cast("bigint")).alias("n_pos"), F.max(DATE).alias("last_date")
        )
        df = df.select(F.lit(f"{s}_{e}").alias("window"), F.col("year").cast("int").alias("year"), "n_rows", "n_pos", "last_date")
        parts = df if parts is None else parts.unionByName(df)
    return parts


@query
def predictions_merge(spark, sf):
    df = merge_predictions(predictions(spark, sf))
    return out(df, ["window", "return", "y_true", "y_prob", "y_pred"])


@query
def market_series_fallback(spark, sf):
    """The day's move per code, as if each code were a file; median over the files."""
    move = (F.col("close") - F.col("open")) / F.col("open")
    df = panel(spark, sf).select(CODE, DATE, move.alias("move"))
    return out(market_series_from_files(df, CODE, "move"), ["move"], (DATE,))


@query
def panel_sink_roundtrip(spark, sf):
    cfg = LiquidityConfig(window_start=FIRST_YEAR, window_end=LAST_YEAR)
    base = feature_years(spark, sf)
    root = shared_path(spark, f"{sf}/filtered", lambda p: build_filtered(spark, base, p, cfg))
    path = build_filtered(spark, base, root, cfg)
    return out(spark.read.parquet(path).withColumn("year", F.col("year").cast("int")), ["year", "amount", "close", "return"])


@query
def liquidity_provenance(spark, sf):
    df = panel(spark, sf)
    cfg = LiquidityConfig(window_start=FIRST_YEAR, window_end=LAST_YEAR)
    one = provenance(df, crosssec.filter_liquid(df), cfg)
    return out(one, one.columns, ())


@query
def label_extract(spark, sf):
    return out(labels.label_extract(labelled(spark, sf)), ["return", "excess_return", "beta"])


# --- cleaning ------------------------------------------------------------------------------------------------------


@query
def dedup_last(spark, sf):
    """The panel loaded twice, the second load with other closes for part of the keys."""
    df = panel(spark, sf).select(CODE, DATE, "close", "volume")
    older = df.withColumns({"close": F.col("close") + 1, src.ORDINAL: F.struct(F.year(DATE).alias("year"), F.lit(1).alias("seq"))})
    newer = df.filter(F.col("volume") > 20).withColumn(
        src.ORDINAL, F.struct(F.year(DATE).alias("year"), F.lit(2).alias("seq"))
    )
    return out(clean.dedup_last(newer.unionByName(older)), ["close", "volume"])


@query
def null_rate_profile(spark, sf):
    return out(clean.null_rates(panel(spark, sf)), ["column", "null_rate"], ())


@query
def numeric_salvage(spark, sf):
    df = messy(spark, sf)
    kept = clean.salvage_numeric(df).columns
    return clean.convertible(df).withColumn("kept", F.col("column").isin(kept))


@query
def calendar_densify(spark, sf):
    """All measures of the panel on every day."""
    return out(clean.densify(build_panel(spark, sf), on_code=True), [c for c in PANEL_COLUMNS if c not in (CODE, DATE)])


def raw_years(spark, sf) -> str:
    """Yearly raw tables under feed names."""
    to_raw = {v: k for k, v in RAW_TO_PANEL.items() if v in PANEL_COLUMNS}
    return shared_path(spark, f"{sf}/raw_years", lambda p: src.write_years(build_panel(spark, sf).withColumnsRenamed(to_raw), p, on_code=True))


@query
def clean_run(spark, sf):
    """Load, market returns and the whole cleaning; an almost empty column goes."""
    raw = src.load_panel(spark, raw_years(spark, sf), FIRST_YEAR, LAST_YEAR)
    raw = raw.withColumn("junk", F.when((F.col(CODE) == "1") & (F.dayofmonth(DATE) == 1), lit(1)))
    df = clean_panel(market.add_market_returns(raw), src.ORDINAL)
    return out(df, sorted(c for c in df.columns if c not in (CODE, DATE)))


@query
def preprocess_run(spark, sf):
    """The whole run over all codes, years and measures: load, clean, densify, features, labels."""
    return preprocess(spark, PanelConfig(FIRST_YEAR, LAST_YEAR, raw_years(spark, sf), extended=True))


@query
def feature_csv_roundtrip(spark, sf):
    """Features and labels written as yearly CSV and read back over all years."""
    root = shared_path(spark, f"{sf}/feature_csv", lambda p: src.write_years(labelled_panel(spark, sf), p, "csv", on_code=True))
    df = src.range_scan(spark, root, FIRST_YEAR - 1, LAST_YEAR + 1, TARGET, "csv")
    return out(df, ["year", "amount", "adj_close", "vol20", "beta", "return", "excess_return", TARGET])


@query
def feature_matrix(spark, sf):
    df = indicators.obv(by_code(panel(spark, sf)))
    names = ml.resolve_features(df, ml.LIVE_NOT_FEATURES)
    return out(ml.feature_matrix(df, names, [CODE, DATE]), names)


@query
def walk_forward_split(spark, sf):
    df = labelled(spark, sf).filter(F.col(TARGET).isNotNull()).select(CODE, DATE, TARGET)
    tagged = ml.walk_forward_split(df, ml.walk_forward_windows(FIRST_YEAR, LAST_YEAR))
    return tagged.groupBy("window", "role").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col(TARGET).cast("bigint")).alias("n_pos"),
        F.min(DATE).alias("first_date"),
        F.max(DATE).alias("last_date"),
    )


@query
def liquidity_filter(spark, sf):
    df = panel(spark, sf).select(CODE, DATE, "amount", "market_value")
    return out(crosssec.liquidity_mask(df), ["liq_score", "liq_keep"])


@query
def cs_zscore(spark, sf):
    df = panel(spark, sf).select(CODE, DATE, "amount")
    df = crosssec.with_zscores(df, {"z_ln_amount": F.ln(F.when(F.col("amount") > 0, F.col("amount")))})
    return out(df, ["z_ln_amount"])


@query
def market_returns(spark, sf):
    return out(market.market_series(panel(spark, sf)), ["market_return", "market_return_fwd"], (DATE,))


# --- indicators and features ---------------------------------------------------------------------------------------


def step(name: str, fn: Callable[[DataFrame], DataFrame], cols: list[str], base: Callable = panel) -> None:
    """Register a per-code feature step: one exchange on the code, then fn."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return out(fn(by_code(base(spark, sf))), cols)

    run.__name__ = name
    query(run)
    STEP_COLUMNS[name] = cols


def _per(prefix: str, windows: tuple[int, ...]) -> list[str]:
    return [f"{prefix}{w}" for w in windows]


TREND = indicators.TREND_DAYS
step("ta_rsi", indicators.rsi, _per("RSI_", TREND))
step("ta_sma", indicators.sma, _per("SMA_", TREND) + [f"Price_SMA{w}_Ratio" for w in TREND])
step("ta_ema", indicators.ema, _per("EMA_", TREND))
step("ta_macd", indicators.macd, ["MACD", "MACD_Signal", "MACD_Hist"])
step("ta_kd", indicators.kd, ["K", "D", "KD_Diff"])
step("ta_williams_r", indicators.williams_r, _per("Williams_R_", (14, 28)))
step("ta_roc_momentum", indicators.roc_momentum, _per("ROC_", (5, 10, 20)) + _per("Momentum_", (5, 10, 20)))
step("ta_atr", indicators.atr, ["ATR_14", "ATR_14_Pct", "ATR_28", "ATR_28_Pct"])
step("ta_bollinger", indicators.bollinger, ["BB_Upper_20", "BB_Middle_20", "BB_Lower_20", "BB_PctB_20"])
step("ta_obv", indicators.obv, ["OBV", "OBV_ROC"])
step("ta_vwap", indicators.vwap, ["VWAP", "Price_VWAP_Ratio"])
step("ta_volume_ratio", indicators.volume_ratio, ["Volume_SMA_5", "Volume_SMA_20", "Volume_Ratio_5", "Volume_Ratio_20"])
step("ta_cci", indicators.cci, ["CCI_14", "CCI_20"])
step("price_derived", flow.price_derived, ["hl_spread", "float_turnover", "cash_trade_share", "intraday_sell_share", "close_chg"])
step("momentum_ext", flow.momentum_ext, ["log_return", "ret_21", "ret_63", "ret_252", "ret_21_pct"])
step("period_to_date_returns", flow.period_to_date_returns, ["ret_mtd", "ret_wtd", "ret_ytd", "ret_qtd"])
step(
    "capm_betas",
    lambda df: flow.capm_betas(beta.daily_return_vol(df)),
    ["capm_beta_21", "capm_beta_189", "capm_beta_252"],
    market_panel,
)
step(
    "flow_basic",
    flow.flow_basic,
    [
        "inst_net_amt_k", "trust_net_amt_m", "margin_turnover", "margin_buy_amt_k", "margin_util_f", "margin_chg_amt_k",
        "maintenance_ratio", "credit_share", "foreign_investable", "insider_shares_k", "inst_buy", "inst_sell",
        "pbr_f", "margin_buy_f", "foreign_sell", "trust_share",
    ],
)
step("flow_runs", flow.flow_runs, ["dealer_run_k", "foreign_run_k"])
step(
    "flow_period_to_date",
    flow.flow_period_to_date,
    [
        "dealer_net_wtd", "dealer_wtd_k", "dealer_mtd_k", "dealer_ytd_k", "foreign_wtd_k", "foreign_ytd_k",
        "inst_amt_mtd_k", "inst_amt_wtd_k", "dealer_amt_wtd_k", "dealer_mtd_k2",
    ],
)
step("flow_buy_days", flow.flow_buy_days, ["inst_buy_days_20"])
step("fundamental_basic", fundamentals.fundamental_basic, ["rev_ly_cum_k", "rev_mom", "rev_per_share", "eps_f"])
step("revenue_growth", fundamentals.revenue_growth, ["rev_chg_63", "rev_chg_252"])
step("revenue_hist_low", fundamentals.revenue_hist_low, ["rev_vs_hist_low"])
step(
    "short_basic",
    fundamentals.short_basic,
    [
        "short_sell_volume_ratio", "short_headroom", "headroom_log", "inst_retail_ratio", "short_net_flow_sec",
        "sl_sell_balance_log", "sl_balance_log", "ms_balance_log",
    ],
)
step("short_chg", fundamentals.short_change, ["short_balance_chg_5d", "short_balance_chg_10d", "short_balance_chg_20d"])
step("excess_features", flow.excess_features, ["ret_1d", "excess_1d", "excess_wtd"], market_panel)
step("valuation", fundamentals.valuation, ["price_to_sales", "equity_k"])
step("eps_ttm", fundamentals.eps_ttm, ["eps_ttm", "eps_ttm_yoy", "pretax_prev_year"])


@query
def short_cover(spark, sf):
    df = fundamentals.days_to_cover(by_code(panel(spark, sf).select(CODE, DATE, "volume", "sl_sell_balance")))
    return out(fundamentals.days_to_cover_rank(df), ["days_to_cover", "days_to_cover_rank"])


@query
def beta_vasicek(spark, sf):
    df = market_panel(spark, sf).select(CODE, DATE, "adj_close", "market_return")
    return out(beta.shrunk_beta(beta.daily_return_vol(by_code(df))), ["daily_return", "vol20", "beta"])


def fii_signed_log(spark, sf):
    return out(panel(spark, sf).select(CODE, DATE, signed_log1p(F.col("fii_net")).alias("fii_signed_log")), ["fii_signed_log"])


QUERIES["signed_log1p"] = fii_signed_log


def gappy(spark, sf) -> DataFrame:
    """The panel's bars with a price missing in one row of five, and zero in one of seven."""
    k = F.col("volume").cast("bigint")
    px = F.when(k % 5 == 0, F.lit(None).cast("double")).otherwise(F.col("adj_close"))
    zero = F.when(k % 7 == 0, lit(0)).otherwise(F.col("adj_close"))
    return panel(spark, sf).select(CODE, DATE, "high", "low", px.alias("adj_close"), zero.alias("with_zero"))


@query
def ta_gaps(spark, sf):
    """Exponential means over missing prices."""
    df = indicators.kd(indicators.ema(by_code(gappy(spark, sf).drop("with_zero"))))
    return out(df, ["EMA_5", "EMA_60", "K", "D"])


@query
def returns_of_zero_prices(spark, sf):
    """A return on a price of zero is infinite, or the bound where it is bounded."""
    df = gappy(spark, sf).select(CODE, DATE, F.col("with_zero").alias("adj_close"), lit(0).alias("market_return"))
    df = beta.daily_return_vol(flow.excess_features(flow.momentum_ext(by_code(df))))
    inf = F.lit(float("inf"))
    flags = {"log_infinite": F.col("log_return") == inf, "daily_infinite": F.col("daily_return") == inf}
    return out(df.withColumns({k: v.cast("int") for k, v in flags.items()}), ["ret_21", "ret_63", "ret_252", "ret_1d", "vol20", *flags])


# --- labels --------------------------------------------------------------------------------------------------------

step(
    "labels",
    labels.add_labels,
    ["return", "return_tick", "return_tick_0", "excess_return", "excess_return_tick"],
    lambda spark, sf: labelled(spark, sf).select(CODE, DATE, "adj_open", "beta", "market_return_fwd"),
)


@query
def label_positive_rates(spark, sf):
    one = labels.positive_rates(labelled(spark, sf))
    return out(one, one.columns, ())


@query
def label_value_counts(spark, sf):
    df = labels.label_value_counts(labelled(spark, sf), ["return_tick", TARGET])
    return out(df, ["value", "n_rows", "share"], ("label",))


@query
def label_histogram(spark, sf):
    df = labelled(spark, sf)
    both = labels.label_histogram(df, "return").unionByName(labels.label_histogram(df, "excess_return"))
    return out(both, ["bin", "bin_low", "n_rows", "mean", "median"], ("label",))


@query
def panel_profile(spark, sf):
    of = {k: [c for n, cols in STEP_COLUMNS.items() if n.startswith(v) for c in cols] for k, v in PROFILE.items()}
    one = evaluate.panel_profile(labelled(spark, sf), of["indicators"], of["short"])
    return out(one, one.columns, ())


# Two steps of a user's: the later one reads what the earlier one makes, and is given first.
OWN_STEPS = (
    Step("range_trend", ("range_share",), ("range_trend",), lambda *_: [{"range_trend": roll(F.avg, 5, 3, F.col("range_share"))}]),
    Step("range_share", ("high", "low"), ("range_share",), lambda *_: [{"range_share": (F.col("high") - F.col("low")) / (F.col("low") + lit(1))}]),
    Step("volume_step", ("volume",), ("volume_step",), lambda *_: [{"__before": lag(F.col("volume"))}, {"volume_step": F.col("volume") - F.col("__before")}]),
)


@query
def own_steps(spark, sf):
    """Feature steps that are not built in, ordered by what they read, on the exchange of a panel by code."""
    return out(run_steps(by_code(panel(spark, sf)), OWN_STEPS), ["range_share", "range_trend", "volume_step"])


# --- cross-section and back-test -----------------------------------------------------------------------------------


@query
def decile_assign(spark, sf):
    return out(ranked(spark, sf), ["y_prob", "decile"])


@query
def decile_counts(spark, sf):
    return bt.decile_counts(ranked(spark, sf))


DECILES = [f"D{i}" for i in range(1, 11)]


@query
def decile_daily_returns(spark, sf):
    daily = bt.decile_daily_returns(ranked(spark, sf), cost_bps=5, capital_usage=0.5)
    return out(bt.decile_table(daily), DECILES, (DATE,))


@query
def benchmark_align(spark, sf):
    df = series_wide(spark, sf).withColumn("no_benchmark", F.col("market").isNull())
    return out(df, ["D1", "market", "excess_D1", "no_benchmark"], (DATE,))


def _long(spark, sf) -> DataFrame:
    return bt.to_long(series_wide(spark, sf))


@query
def performance_metrics(spark, sf):
    df = bt.performance_metrics(_long(spark, sf))
    return out(df, ["ann_return", "ann_std", "sharpe", "mdd", "calmar", "hit_rate", "n_days"], ("series",))


@query
def alpha_ir(spark, sf):
    return out(bt.alpha_ir(_long(spark, sf)), ["n_common", "alpha", "ir"], ("series",))


@query
def annual_returns(spark, sf):
    return out(bt.annual_returns(series_wide(spark, sf)), ["strategy", "market"], ("year",))


@query
def cumulative_nav(spark, sf):
    return out(bt.cumulative_nav(_long(spark, sf)), ["nav", "log10_nav"], ("series", DATE))


@query
def decile_summary(spark, sf):
    df = bt.decile_summary(bt.performance_metrics(_long(spark, sf)))
    return out(df, ["ln_ann_return", "sharpe"], ("series",))


@query
def relative_nav(spark, sf):
    return out(bt.relative_nav(series_pair(spark, sf)), ["rel", "dd"], (DATE,))


@query
def drawdown_curve(spark, sf):
    return out(bt.drawdown_curve(series_pair(spark, sf)), ["dd"], (DATE,))


def _episodes(spark, sf) -> DataFrame:
    return bt.drawdown_episodes(bt.relative_nav(series_pair(spark, sf)).select(DATE, "dd"))


@query
def drawdown_episodes(spark, sf):
    return out(_episodes(spark, sf), ["trough", "recovery", "depth", "days_to_trough", "days_underwater", "ongoing"], ("peak",))


@query
def drawdown_topk(spark, sf):
    df = bt.drawdown_topk(_episodes(spark, sf))
    return out(df, ["peak", "trough", "recovery", "depth", "days_underwater", "longest"], ("rank",))


@query
def strategy_beta_rolling(spark, sf):
    return out(bt.strategy_beta(series_pair(spark, sf), "rolling"), ["beta"], (DATE,))


@query
def strategy_beta_expanding(spark, sf):
    return out(bt.strategy_beta(series_pair(spark, sf), "expanding"), ["beta"], (DATE,))


@query
def strategy_beta_full(spark, sf):
    return out(bt.strategy_beta(series_pair(spark, sf), "full"), ["beta"], (DATE,))


@query
def beta_neutral_excess(spark, sf):
    return out(bt.beta_neutral_excess(series_pair(spark, sf)), ["beta", "excess"], (DATE,))


# --- evaluation and models -----------------------------------------------------------------------------------------


def _evaluated(spark, sf) -> DataFrame:
    return predictions(spark, sf).filter("y_true is not null")


@query
def classifier_metrics(spark, sf):
    df = evaluate.classifier_metrics(_evaluated(spark, sf), ["window"])
    return out(df, [c for c in df.columns if c != "window"], ("window",))


@query
def f1_threshold(spark, sf):
    """Scores of each window's first quarter of days are missing, as for rows that no fold validates."""
    df = _evaluated(spark, sf)
    days = df.groupBy("window").agg(F.min(DATE).alias("lo"), F.max(DATE).alias("hi"))
    df = df.join(F.broadcast(days), "window")  # one row per window
    late = F.datediff(F.col(DATE), F.col("lo")) * 4 >= F.datediff("hi", "lo")
    df = df.withColumn("oof_prob", F.when(late, F.col("y_prob")))
    return out(evaluate.f1_threshold(df, ["window"]), ["threshold", "f1"], ("window",))


def _train_rows(spark, sf, *cols: str) -> DataFrame:
    df = labelled(spark, sf).filter(F.col(TARGET).isNotNull()).select(CODE, DATE, *cols)
    tagged = ml.walk_forward_split(df, ml.walk_forward_windows(FIRST_YEAR, LAST_YEAR))
    return tagged.filter("role = 'train'").drop("role")


@query
def vol_rank_weights(spark, sf):
    df = _train_rows(spark, sf, "vol20").withColumn("vol20", F.round("vol20", 9))
    return out(crosssec.vol_rank_weights(df, ["window"]), ["vol20", "weight"], ("window", CODE, DATE))


@query
def cv_folds(spark, sf):
    return ml.cv_folds(_train_rows(spark, sf), 3, ["window"])


def features(spark: SparkSession, sf: str) -> DataFrame:
    """All features and labels of the panel, by year."""
    return spark.read.parquet(feature_store(spark, sf))


def feature_store(spark: SparkSession, sf: str) -> str:
    cfg = PanelConfig(FIRST_YEAR, LAST_YEAR, extended=True)
    return shared_path(spark, f"{sf}/features", lambda p: src.write_years(build_features(panel_on_code(spark, sf), cfg, on_code=True), p, on_code=True))


STEP_COLUMNS["short_cover"] = ["days_to_cover", "days_to_cover_rank"]
STEP_COLUMNS["beta_vasicek"] = ["daily_return", "vol20", "beta"]


@query
def feature_table(spark, sf):
    """The whole feature run in one plan."""
    df = build_features(panel_on_code(spark, sf), PanelConfig(FIRST_YEAR, LAST_YEAR, extended=True), on_code=True)
    return out(df, [c for cols in STEP_COLUMNS.values() for c in cols])


# The model queries read all rows and all features, with the operators' own rounds, patience, leaves and trials; the README has the seconds.
MODEL = boosting.BoostParams(rounds=ml.FINAL_ROUNDS, bagging_fraction=0.9, bagging_freq=1, feature_fraction=0.9)
TRIALS = WalkForwardConfig.n_trials
SPLIT_YEAR = LAST_YEAR
_fitted: dict[tuple[str, str], object] = {}


def _model_rows(spark, sf) -> DataFrame:
    """code, date, target, return and the features of every row with a target, with its fold (one row per day, by broadcast)."""

    def build() -> DataFrame:
        df = features(spark, sf).filter(F.col(TARGET).isNotNull())
        return ml.with_folds(df.select(CODE, DATE, *dict.fromkeys([TARGET, "return", *model_features(spark, sf)])), 3)

    return _once(spark, f"{sf}/model_rows", build)


def model_features(spark, sf) -> list[str]:
    return ml.resolve_features(features(spark, sf), ml.LIVE_NOT_FEATURES)


def _binned(spark, sf, name: str, rows: Callable[[], DataFrame]) -> boosting.Binned:
    """Blocks and edges of training rows, once for all fits on them."""
    names = model_features(spark, sf)
    table = shared(spark, f"{sf}/{name}_edges", lambda: boosting.edge_table(spark, names, boosting.find_edges(rows(), names)))
    edges = boosting.edges_of(table, names)
    return boosting.Binned(shared(spark, f"{sf}/{name}_blocks", lambda: boosting.bin_rows(rows(), names, TARGET, edges=edges).blocks), names, edges)


def _once(spark, key: str, make):
    """A fitted model (or models), once per application; queries that read the same one share it."""
    slot = (spark.sparkContext.applicationId, key)
    if slot not in _fitted:
        _fitted[slot] = make()
    return _fitted[slot]


def _fit(spark, sf) -> boosting.Booster:
    """Fitted on the years before SPLIT_YEAR, with all rounds."""

    def make() -> boosting.Booster:
        data = _binned(spark, sf, "train", lambda: _model_rows(spark, sf).filter(F.year(DATE) < SPLIT_YEAR))
        return boosting.fit(data, MODEL)

    return _once(spark, f"{sf}/fit", make)


def _folds(spark, sf) -> list[boosting.Booster]:
    return _once(spark, f"{sf}/folds", lambda: boosting.fit_folds(_binned(spark, sf, "folds", lambda: _model_rows(spark, sf)), MODEL, 3, ml.PATIENCE))


@query
def gbt_fit_predict(spark, sf):
    rows = _model_rows(spark, sf)
    return boosting.predict(_fit(spark, sf), rows, [CODE, DATE, TARGET]).withColumnRenamed(TARGET, "y_true")


@query
def score_evaluate(spark, sf):
    test = _model_rows(spark, sf).filter(F.year(DATE) >= SPLIT_YEAR)
    scored = ml.prediction_table(boosting.predict(_fit(spark, sf), test, [CODE, DATE, TARGET, "return"]), TARGET, 0.4)
    return evaluate.classifier_metrics(scored.withColumn("window", F.lit("holdout")), ["window"])


@query
def feature_importance(spark, sf):
    return boosting.gains(spark, _fit(spark, sf))


@query
def boosting_rounds(spark, sf):
    """Validation loss of each fold after each round, and the round at which the fold's model was cut."""
    rows = [(k, r, float(loss), r == m.rounds) for k, m in enumerate(_folds(spark, sf), 1) for r, loss in enumerate(m.losses)]
    return spark.createDataFrame(rows, "fold int, round int, log_loss double, is_best boolean")


@query
def binned_matrix(spark, sf):
    """Rows in each bin of each feature of the folds' training table, from the stored blocks."""
    data = _binned(spark, sf, "folds", lambda: _model_rows(spark, sf))
    return boosting.bin_counts(data)


@query
def oof_probabilities(spark, sf):
    def build() -> DataFrame:
        return boosting.oof(_folds(spark, sf), _model_rows(spark, sf), [CODE, DATE, TARGET, "fold"])

    return shared(spark, f"{sf}/oof", build)


@query
def oof_pattern(spark, sf):
    """What is fixed about the out-of-fold table: keys, folds, labels, and which rows have a probability."""
    p = F.col("oof_prob")
    fine = F.when(p.isNotNull(), (p > 0) & (p < 1))
    return QUERIES["oof_probabilities"](spark, sf).select(CODE, DATE, "fold", F.col(TARGET).alias("y_true"), p.isNotNull().alias("has_prob"), fine.alias("is_prob"))


@query
def random_search(spark, sf):
    """Trials over three folds, all fits side by side on one binned table."""

    def make():
        rng = random.Random(42)
        data = _binned(spark, sf, "folds", lambda: _model_rows(spark, sf))
        return boosting.search(data, [ml.sample_params(rng) for _ in range(TRIALS)], 3, ml.SEARCH_ROUNDS, ml.PATIENCE)[1]

    return boosting.trial_table(spark, _once(spark, f"{sf}/search", make))


def walk_output(spark: SparkSession, sf: str) -> str:
    """Folder of one walk-forward run over all windows."""

    def run(path: str) -> None:
        cfg = WalkForwardConfig(window_start=FIRST_YEAR, window_end=LAST_YEAR, output_dir=path)
        WalkForward(spark, feature_store(spark, sf), cfg).run()

    return shared_path(spark, f"{sf}/walk", run)


@query
def walk_forward(spark, sf):
    """Predictions of every window, merged to one row per key."""
    return merge_predictions(read_predictions(spark, f"{walk_output(spark, sf)}/predictions"))


@query
def walk_forward_rows(spark, sf):
    """What is fixed about the predictions: keys, windows, labels and returns."""
    df = QUERIES["walk_forward"](spark, sf)
    return out(df.withColumn("is_prob", (F.col("y_prob") > 0) & (F.col("y_prob") < 1)), ["window", "return", "y_true", "is_prob"])


@query
def walk_forward_metrics(spark, sf):
    """The window metrics, computed again from the stored predictions, against the summary that the run wrote."""
    again = evaluate.classifier_metrics(QUERIES["walk_forward"](spark, sf), ["window"]).select("window", F.col("n_test").alias("n"), F.col("accuracy").alias("a"))
    kept = QUERIES["walk_forward_summary"](spark, sf).select("window", "n_test", "accuracy", "test_year", "hyperparams_tuned")
    both = kept.join(F.broadcast(again), "window")  # one row per window
    return both.select(
        "window", F.col("test_year").cast("int").alias("test_year"), F.col("n_test").cast("long").alias("n_test"),
        ((F.col("n") == F.col("n_test")) & (F.abs(F.col("a") - F.col("accuracy")) < 1e-9)).alias("agrees"),
        F.col("hyperparams_tuned").cast("boolean").alias("tuned"),
    )


@query
def walk_forward_summary(spark, sf):
    return spark.read.option("header", True).option("inferSchema", True).csv(f"{walk_output(spark, sf)}/walk_forward_summary")
