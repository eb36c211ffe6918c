"""Cross-sectional operators: per-date z-scores, ranks and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.num import lit
from tidepanel.functions.ordered import average_rank, exact_quantile, ordered_running_sum
from tidepanel.functions.windows import CODE, DATE, drop_private
from tidepanel.sources.scratch import save

# Weights and share kept of the liquidity filter.
LIQ_W1 = 0.1004
LIQ_W2 = 0.1896
LIQ_KEEP_RATIO = 0.20



def assign_deciles(df: DataFrame, n: int = 10, score: str = "y_prob", task_rows: int | None = None) -> DataFrame:
    """Group 1 holds the highest scores of the day; ties in code order; NULL on days with fewer than n scores."""
    scored = F.col(score).isNotNull()
    order = [F.col(score).desc_nulls_last(), F.col(CODE)]
    df = ordered_running_sum(
        df, [DATE], order, {"__rank": F.when(scored, 1).otherwise(0)}, {"__size": "__rank"}, task_rows
    )
    rank, size = F.col("__rank").cast("double"), F.col("__size").cast("double")
    group = F.greatest(F.least(F.ceil(rank / size * n), F.lit(n)), F.lit(1)).cast("int")
    return drop_private(df.withColumn("decile", F.when(scored & (F.col("__size") >= n), group)))


def day_moments(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Mean and sample deviation of each value per date, aggregated map-side first: one row per day."""
    aggs = []
    for o, x in values.items():
        aggs += [F.avg(x).alias(f"__m_{o}"), F.stddev_samp(x).alias(f"__d_{o}")]
    return df.groupBy(DATE).agg(*aggs)


def with_zscores(df: DataFrame, values: dict[str, Column], days: DataFrame | None = None) -> DataFrame:
    """Per-date z-scores, NULL where the deviation is zero; the moments come by a broadcast of one row per day."""
    days = day_moments(df, values) if days is None else days
    df = df.withColumns({f"__v_{o}": x for o, x in values.items()})
    df = df.join(F.broadcast(days), DATE, "left")
    # A deviation this small against the mean is rounding noise of equal values.
    out = {}
    for o in values:
        dev = F.col(f"__d_{o}")
        real = dev > F.abs(F.col(f"__m_{o}")) * lit(1e-14)
        out[o] = (F.col(f"__v_{o}") - F.col(f"__m_{o}")) / F.when(real & (dev > 0), dev)
    df = df.withColumns(out)
    return df.drop(*[f"__{k}_{o}" for k in "vmd" for o in values])


def _positive_log(x: Column) -> Column:
    return F.ln(F.when(x > 0, x))


def _liquidity_values(df: DataFrame) -> dict[str, Column]:
    missing = [c for c in ("amount", "market_value") if c not in df.columns]
    if missing:
        raise KeyError(f"the liquidity filter needs {missing}")
    amount, value = F.col("amount"), F.col("market_value")
    turnover = F.when(amount > 0, amount) / F.when(value > 0, value)
    return {"__z1": _positive_log(amount), "__z2": _positive_log(value), "__z3": F.ln(turnover)}


def liquidity_score(
    df: DataFrame, w1: float = LIQ_W1, w2: float = LIQ_W2, days: DataFrame | None = None
) -> DataFrame:
    """w1 Z(ln amount) + w2 Z(ln market value) + (1 - w1 - w2) Z(ln turnover); NULL where an input is not positive."""
    df = with_zscores(df, _liquidity_values(df), days)
    score = lit(w1) * F.col("__z1") + lit(w2) * F.col("__z2") + lit(1.0 - w1 - w2) * F.col("__z3")
    return df.withColumn("liq_score", score).drop("__z1", "__z2", "__z3")


def _with_liquidity_share(df: DataFrame, task_rows: int | None) -> DataFrame:
    scored = F.col("liq_score").isNotNull()
    order = [F.col("liq_score").desc_nulls_last(), F.col(CODE)]
    df = ordered_running_sum(
        df, [DATE], order, {"__rank": F.when(scored, 1).otherwise(0)}, {"__size": "__rank"}, task_rows
    )
    share = F.col("__rank").cast("double") / F.when(F.col("__size") > 0, F.col("__size"))
    return df.withColumn("__share", F.when(scored, share))


def liquidity_mask(
    df: DataFrame,
    w1: float = LIQ_W1,
    w2: float = LIQ_W2,
    keep_ratio: float = LIQ_KEEP_RATIO,
    task_rows: int | None = None,
) -> DataFrame:
    """Adds liq_score and liq_keep: true for the top keep_ratio of the day's names by score."""
    df = _with_liquidity_share(liquidity_score(df, w1, w2), task_rows)
    keep = F.coalesce(F.col("__share") <= keep_ratio, F.lit(False))
    return drop_private(df.withColumn("liq_keep", keep))


def filter_liquid(
    df: DataFrame,
    w1: float = LIQ_W1,
    w2: float = LIQ_W2,
    keep_ratio: float = LIQ_KEEP_RATIO,
    task_rows: int | None = None,
) -> DataFrame:
    """The rows that liquidity_mask keeps, without exchanging wide rows.

    Four narrow columns are ranked to find each day's last name kept; the wide rows then meet that
    cutoff by broadcast. Moments and cutoffs (one row per day) are written, so both passes see the same scores.
    """
    narrow = df.select(CODE, DATE, "amount", "market_value")
    days = save(day_moments(narrow, _liquidity_values(narrow)), "moments")
    ranked = _with_liquidity_share(liquidity_score(narrow, w1, w2, days), task_rows)
    last = F.max_by(F.struct("liq_score", CODE), F.col("__rank"))
    cut = ranked.filter(F.col("__share") <= keep_ratio).groupBy(DATE).agg(last.alias("__cut"))
    cut = save(cut.select(DATE, F.col("__cut.liq_score").alias("__cut_score"), F.col("__cut.code").alias("__cut_code")), "cutoffs")
    wide = liquidity_score(df, w1, w2, days).join(F.broadcast(cut), DATE)
    at_cut = (F.col("liq_score") == F.col("__cut_score")) & (F.col(CODE) <= F.col("__cut_code"))
    kept = wide.filter((F.col("liq_score") > F.col("__cut_score")) | at_cut)
    return kept.drop("liq_score", "__cut_score", "__cut_code")


def vol_rank_weights(df: DataFrame, group: list[str], vol: str = "vol20", task_rows: int | None = None) -> DataFrame:
    """Sample weights: descending average rank of volatility over the group, scaled to mean 1.

    Missing volatility takes the group's exact median.
    """
    median = exact_quantile(df, group, vol, 0.5, "__median", task_rows)
    if group:
        # One row per group; the groups are the training windows.
        df = df.join(F.broadcast(median), group, "left")
    else:
        df = df.withColumn("__k", F.lit(1)).join(median.withColumn("__k", F.lit(1)), "__k", "left")
    df = df.withColumn("__vol", F.coalesce(F.col(vol), F.col("__median")))
    df = average_rank(df, group, "__vol", "__rank", descending=True, task_rows=task_rows)
    # The mean of rank / n over n rows is (n + 1) / (2 n), whatever the ties.
    n = F.col("__rank_n")
    return drop_private(df.withColumn("weight", (F.col("__rank") / n) / ((n + 1) / (2 * n))))
