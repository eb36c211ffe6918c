"""The two end-to-end runs: train walk-forward on a (filtered) feature table, and back-test the predictions."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from tidepanel.operators import labels, ml
from tidepanel.plans.liquidity import LiquidityConfig, build_filtered, provenance_table
from tidepanel.plans.report import BacktestConfig, build_report, write_report
from tidepanel.plans.walkforward import WalkForward, WalkForwardConfig, WindowResult
from tidepanel.sources.panel import load_params, range_scan
from tidepanel.sources.results import read_market_series, read_predictions, write_result


@dataclass(frozen=True)
class TrainRun:
    features: str
    output_dir: str
    label: str = "excess_return_tick"
    window_start: int = 2014
    window_end: int = 2025
    params_inline: dict | None = None
    params_path: str | None = None
    liquidity: LiquidityConfig | None = field(default_factory=LiquidityConfig)
    filtered_root: str = "database_make_liq_filtered"
    diagnostics: bool = False
    fmt: str = "parquet"  # of the feature years; filtered years are Parquet
    model: WalkForwardConfig = field(default_factory=lambda: WalkForwardConfig(use_vol_weight=False))


def diagnose(spark: SparkSession, run: TrainRun) -> dict[str, DataFrame]:
    """Label distributions and the label extract of all feature years."""
    df = range_scan(spark, run.features, run.window_start, run.window_end, run.label, run.fmt)
    out = {
        f"{c}_dist": labels.label_histogram(df, c) for c in ("return", "excess_return") if c in df.columns
    }
    ticks = [c for c in ("return_tick", "excess_return_tick") if c in df.columns]
    if ticks:
        out["tick_dist"] = labels.label_value_counts(df, ticks)
    extract = labels.label_extract(df)
    if extract is not None:
        out["labels"] = extract
    return out


def train(spark: SparkSession, run: TrainRun) -> list[WindowResult]:
    """Fixed parameters, optional liquidity filter, then every window."""
    params = None
    if run.params_inline is not None or run.params_path is not None:
        params = load_params(spark, run.params_inline, run.params_path)
    if run.diagnostics:
        for name, df in diagnose(spark, run).items():
            write_result(df, f"{run.output_dir}/diagnostics/{name}", "csv")
    root = run.features
    if run.liquidity is not None:
        liq = replace(run.liquidity, window_start=run.window_start, window_end=run.window_end, label=run.label)
        root = build_filtered(spark, run.features, run.filtered_root, liq, run.fmt)
        meta = provenance_table(spark, root.removesuffix("/features"))
        if meta is not None:
            write_result(meta, f"{run.output_dir}/liquidity_filter_meta", "json")
    cfg = replace(
        run.model,
        window_start=run.window_start,
        window_end=run.window_end,
        target_col=run.label,
        preset_params=params or run.model.preset_params,
        excluded=set(run.model.excluded) | ml.LIVE_NOT_FEATURES,
        output_dir=run.output_dir,
        fmt="parquet" if run.liquidity is not None else run.fmt,
    )
    return WalkForward(spark, root, cfg).run()


def backtest(
    spark: SparkSession, experiment: str, features: str, out: str, cfg: BacktestConfig = BacktestConfig(), fmt: str = "parquet"
) -> dict[str, DataFrame]:
    """Report on the predictions below an experiment folder against the market series of the feature table."""
    tables = build_report(read_predictions(spark, f"{experiment}/predictions"), read_market_series(spark, features, cfg.market_col, fmt), cfg)
    write_report(tables, out, provenance=provenance_table(spark, experiment))
    return tables
