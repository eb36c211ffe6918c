"""Back-test report: predictions and market series to the full set of result tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators import backtest as bt
from tidepanel.operators.crosssec import assign_deciles
from tidepanel.sources.results import merge_predictions, write_result
from tidepanel.sources.scratch import save


@dataclass(frozen=True)
class BacktestConfig:
    n_deciles: int = 10
    cost_bps: float = 0.0
    annual_days: int = 252
    capital_usage: float = 1.0
    market_col: str = "market_return_fwd"


def build_report(predictions: DataFrame, market: DataFrame, cfg: BacktestConfig = BacktestConfig()) -> dict[str, DataFrame]:
    """All result tables by name. Everything after the daily returns is dates x series in size."""
    ranked = assign_deciles(merge_predictions(predictions), cfg.n_deciles)
    daily = bt.decile_daily_returns(ranked, cfg.cost_bps, cfg.capital_usage)
    wide = bt.with_benchmark(bt.decile_table(daily, cfg.n_deciles), market, cfg.market_col)
    wide = save(wide, "daily_returns")
    long = bt.to_long(wide)
    pair = wide.select("date", F.col("D1").alias("s"), F.col("market").alias("m"))
    perf = bt.performance_metrics(long, cfg.annual_days)
    metrics = perf.join(bt.alpha_ir(long, cfg.annual_days).drop("n_common"), "series", "left")
    episodes = bt.drawdown_episodes(bt.relative_nav(pair).select("date", "dd"))
    return {
        "decile_counts": bt.decile_counts(ranked),
        "daily_returns": wide,
        "decile_metrics": metrics,
        "cumulative": bt.cumulative_nav(long),
        "decile_summary": bt.decile_summary(metrics),
        "annual": bt.annual_returns(wide),
        "drawdown": bt.drawdown_curve(pair),
        "relative_nav": bt.relative_nav(pair),
        "drawdown_episodes": episodes,
        "drawdown_topk": bt.drawdown_topk(episodes),
        "beta_neutral": bt.beta_neutral_excess(pair),
    }


def write_report(tables: dict[str, DataFrame], out: str, fmt: str = "csv", provenance: DataFrame | None = None) -> None:
    """One folder per table; the filter provenance of the predictions beside them, when known."""
    for name, df in tables.items():
        write_result(df, f"{out}/{name}", fmt)
    if provenance is not None:
        write_result(provenance.coalesce(1), f"{out}/liquidity_filter_meta", "json")
