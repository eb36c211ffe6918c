"""Raw panel to features and labels: an ordered registry of steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.ewm import smooth
from tidepanel.functions.windows import CODE, DATE, by_code, exchange_parts, run_stages
from tidepanel.operators import beta, clean, flow, fundamentals, indicators, labels, market
from tidepanel.plans.steps import Step, run_steps
from tidepanel.sources.panel import ORDINAL, load_panel
from tidepanel.sources.scratch import save


@dataclass(frozen=True)
class PanelConfig:
    start_year: int = 2014
    end_year: int = 2016
    db_dir: str = "database"
    fmt: str = "parquet"
    return_clip: float = 0.15
    tick_threshold: float = 0.01
    tick0_threshold: float = 0.0
    beta_window: int = 60
    short_windows: tuple[int, ...] = (5, 10, 20)
    short_log_transform: bool = True
    skip_year_check: bool = False
    extended: bool = False
    steps: tuple[Step, ...] = ()  # own features, after the built-in ones and before the labels

    def __post_init__(self):
        if not self.skip_year_check and self.end_year - self.start_year < 2:
            raise ValueError("the year range must span at least two years")


@dataclass(frozen=True)
class Family:
    """Per-code features computed together over few columns: their windows share operators and sorts.

    reads: columns the features may use; all others ride along packed in one struct, so a window
    operator copies a handful of fields instead of hundreds.
    """

    name: str
    reads: tuple[str, ...]
    needs: tuple[str, ...]
    run: Callable[[DataFrame, set[str], PanelConfig], DataFrame]


_BARS = ("high", "low", "adj_close", "volume")


def _smoothing(df: DataFrame, _cols: set[str], _cfg: PanelConfig) -> DataFrame:
    i = indicators
    return smooth(df, i.rsi_recipe(), i.ema_recipe(), i.macd_recipe(), i.kd_recipe(), i.atr_recipe())


def _prices(df: DataFrame, cols: set[str], _cfg: PanelConfig) -> DataFrame:
    i = indicators
    fns = (i.sma, i.williams_r, i.roc_momentum, i.bollinger, i.obv, i.vwap, i.volume_ratio, i.cci, flow.momentum_ext)
    return run_stages(df, *[f.stages(cols) for f in fns])


def _risk(df: DataFrame, cols: set[str], _cfg: PanelConfig) -> DataFrame:
    # The betas read the daily return, one level later.
    return run_stages(df, beta.daily_return_vol.stages(cols), [{}, *flow.capm_betas.stages(cols)])


def _periods(df: DataFrame, cols: set[str], cfg: PanelConfig) -> DataFrame:
    parts = [[{}, *flow.period_to_date_returns.stages(cols)], flow.flow_period_to_date.stages(cols)]
    if cfg.extended:
        parts.append([{}, *flow.excess_features.stages(cols)])
    return run_stages(df, *parts)


def _flows(df: DataFrame, cols: set[str], cfg: PanelConfig) -> DataFrame:
    f = fundamentals
    return run_stages(
        df,
        flow.price_derived.stages(cols),
        flow.flow_basic.stages(cols),
        flow.flow_buy_days.stages(cols),
        f.short_basic.stages(cols, cfg.short_log_transform),
        f.short_change.stages(cols, cfg.short_windows),
        f.days_to_cover.stages(cols),
        flow.flow_runs.stages(cols),
    )


def _fundamentals(df: DataFrame, cols: set[str], cfg: PanelConfig) -> DataFrame:
    f = fundamentals
    parts = [f.fundamental_basic.stages(cols), f.revenue_growth.stages(cols), f.revenue_hist_low.stages(cols)]
    if cfg.extended:
        parts += [f.valuation.stages(cols), f.eps_ttm.stages(cols)]
    return run_stages(df, *parts)


# In an order that keeps families of equal row order next to each other.
FAMILIES = [
    Family("smoothing", ("high", "low", "adj_close"), ("high", "low", "adj_close"), _smoothing),
    Family("prices", _BARS, _BARS, _prices),
    Family("risk", ("adj_close", "market_return"), ("adj_close", "market_return"), _risk),
    Family(
        "fundamentals",
        (
            "monthly_revenue", "monthly_revenue_ly_cum", "monthly_revenue_mom", "fii_shares", "eps", "pretax_profit",
            "market_value", "equity",
        ),
        (),
        _fundamentals,
    ),
    Family(
        "flows",
        (
            "high", "low", "close", "volume", "fii_shares", "insider_shares", "intraday_shares", "intraday_sell_pct",
            "fii_net", "dealer_net", "trust_net", "margin_buy", "margin_sell", "margin_balance", "margin_util",
            "ms_balance", "ms_limit", "fii_investable", "pbr", "sl_sell_balance", "sl_balance",
        ),
        (),
        _flows,
    ),
    Family(
        "periods",
        ("adj_close", "market_return", "close", "fii_net", "dealer_net", "trust_net"),
        ("adj_close",),
        _periods,
    ),
]

def _require(name: str, needs: tuple[str, ...], df: DataFrame) -> None:
    missing = [c for c in needs if c not in df.columns]
    if missing:
        raise RuntimeError(f"step {name!r} lacks {missing}")


def run_family(df: DataFrame, family: Family, cfg: PanelConfig) -> DataFrame:
    _require(family.name, family.needs, df)
    kept = [c for c in df.columns if c in (CODE, DATE, *family.reads)]
    rest = [c for c in df.columns if c not in kept]
    narrow = df.select(*kept, F.struct(*rest).alias("rest")) if rest else df
    made = family.run(narrow, set(kept), cfg)
    new = [c for c in made.columns if c not in kept and c != "rest"]
    return made.select(*kept, *new, *([F.col("rest.*")] if rest else []))


def clean_panel(df: DataFrame, ordinal: str) -> DataFrame:
    """De-duplicate, screen columns, align to the calendar.

    The rows are exchanged once, on the code, and stay there: nothing is written, unless text columns are read twice.
    """
    df = clean.drop_sparse(df, rates=clean.kept_null_rates(df, ordinal))
    text = any(kind == "string" for c, kind in df.dtypes if c not in (CODE, DATE))
    df = save(clean.dedup_last(df, ordinal), "deduped") if text else clean.dedup_on_code(df, ordinal)
    df = clean.salvage_numeric(df)
    if "adj_close" not in df.columns:
        raise RuntimeError("step 'densify' lacks ['adj_close']")
    return clean.repair_market(clean.densify(df, on_code=not text))


def per_code_features(df: DataFrame, cfg: PanelConfig, on_code: bool = False) -> DataFrame:
    """All features that look at one code at a time, on one exchange, or on none when df is partitioned on the code already."""
    df = df if on_code else by_code(df)
    for family in FAMILIES:
        df = run_family(df, family, cfg)
    return run_steps(df, cfg.steps, cfg)


def build_features(df: DataFrame, cfg: PanelConfig, on_code: bool = False) -> DataFrame:
    """Features and labels of a clean panel with market returns.

    The wide rows are exchanged on the code, or not at all when df is partitioned on it already (on_code). What looks across
    codes (variance of betas, rank of days to cover) is computed from a few columns on the side and joined: per-day tables by
    broadcast, the rank before the features make the rows wide: by code and date, or as one row per code with on_code.
    """

    def placed(rows: DataFrame) -> DataFrame:
        return rows if on_code else by_code(rows)

    wide, ranked = df, {"volume", "sl_sell_balance"} <= set(df.columns)
    if ranked:
        short = placed(df.select(CODE, DATE, "volume", "sl_sell_balance"))
        ranks = fundamentals.days_to_cover_rank(fundamentals.days_to_cover(short)).select(CODE, DATE, F.col("days_to_cover_rank").alias("__cover_rank"))
        if on_code:
            # A code has at most one row per calendar day, so its ranks fit one row; met on the code alone, no wide row moves for them.
            ranks = ranks.groupBy(CODE).agg(F.map_from_entries(F.collect_list(F.struct(DATE, "__cover_rank"))).alias("__ranks"))
            wide = df.join(ranks, CODE, "left").withColumn("__cover_rank", F.try_element_at("__ranks", F.col(DATE))).drop("__ranks")
        else:
            parts = exchange_parts(df)
            wide = df.repartition(parts, CODE, DATE).join(ranks.repartition(parts, CODE, DATE), [CODE, DATE], "left")
    out = per_code_features(wide, cfg, on_code)
    prices = placed(df.select(CODE, DATE, "adj_close", "market_return"))

    def with_labels(narrow: DataFrame, _cols: set[str], _cfg: PanelConfig) -> DataFrame:
        narrow = beta.shrunk_beta(narrow, cfg.beta_window, source=beta.daily_return_vol(prices))
        return labels.add_labels(narrow, cfg.return_clip, cfg.tick_threshold, cfg.tick0_threshold)

    reads = ("daily_return", "market_return", "market_return_fwd", "adj_open")
    out = run_family(out, Family("labels", reads, reads, with_labels), cfg)
    return out.withColumn("days_to_cover_rank", F.col("__cover_rank")).drop("__cover_rank") if ranked else out


def preprocess(spark: SparkSession, cfg: PanelConfig) -> DataFrame:
    """The whole run: load, market returns, clean, features, labels."""
    raw = load_panel(spark, cfg.db_dir, cfg.start_year, cfg.end_year, cfg.fmt)
    # Rows of every day are many times those that were read, and are where their features are made: they are neither written nor exchanged.
    return build_features(clean_panel(market.add_market_returns(raw), ORDINAL), cfg, on_code=True)
