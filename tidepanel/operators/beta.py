"""Daily return, volatility and the shrunk market beta."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.num import clip, div_ieee, fill, finite, lit
from tidepanel.functions.ordered import RANGE_ROWS, TASK_ROWS
from tidepanel.functions.windows import (
    CODE,
    DATE,
    Stages,
    drop_private,
    feature,
    lag,
    roll,
    rolling_beta,
    rolling_variance,
    run_stages,
)
from tidepanel.sources.scratch import save


@feature
def daily_return_vol(cols: set[str]) -> Stages:
    x = F.col("adj_close")
    # An infinite return (from a zero price) counts as missing here.
    vol = roll(F.stddev_samp, 20, 10, finite(F.col("daily_return"))) * lit(math.sqrt(252))
    return [{"daily_return": fill(div_ieee(x, lag(x)) - 1, 0)}, {"vol20": fill(vol, 0)}]


def next_code_value(df: DataFrame, value: str, task_rows: int | None = None) -> DataFrame:
    """code -> first non-null value (by date) of the nearest later code, in code order, that has one.

    One row per code. Beyond task_rows codes, the codes are range-partitioned and each part is completed with
    the first value of a later part.
    """
    task_rows = TASK_ROWS if task_rows is None else task_rows
    known_on = F.when(F.col(value).isNotNull(), F.col(DATE))
    first = df.groupBy(CODE).agg(F.min_by(F.col(value), known_on).alias("__own"))

    def following(*key: Column) -> Column:
        # Descending order, so that the growing frame costs constant time per row.
        down = Window.partitionBy(*key).orderBy(F.col(CODE).desc()).rowsBetween(Window.unboundedPreceding, -1)
        return F.last("__own", ignorenulls=True).over(down)

    n = df.agg(F.approx_count_distinct(CODE).alias("n")).first()["n"]
    if n <= task_rows:
        return first.select(CODE, following(F.lit(1)).alias("__next"))
    parts = max(2, -(-n // RANGE_ROWS))
    spread = save(first.repartitionByRange(parts, CODE).withColumn("__part", F.spark_partition_id()), "spread")
    first_known = F.when(F.col("__own").isNotNull(), F.col(CODE))
    heads = spread.groupBy("__part").agg(F.min_by(F.col("__own"), first_known).alias("__head"))
    later = Window.partitionBy(F.lit(1)).orderBy(F.col("__part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("__part", F.last("__head", ignorenulls=True).over(later).alias("__later"))
    local = spread.withColumn("__local", following(F.col("__part")))
    return local.join(heads, "__part").select(CODE, F.coalesce("__local", "__later").alias("__next"))


def _raw_and_variance(df: DataFrame, window: int) -> DataFrame:
    """Adds raw (rolling beta, bounded) and est (its rolling variance)."""
    least = max(window // 2, 10)
    beta = rolling_beta("beta", "daily_return", "market_return", {"__raw": (window, least)})
    spread = rolling_variance("est", "raw", {"est": (window, least)})
    return run_stages(df, [*beta, {"raw": clip(F.col("__raw"), -5, 5)}, *spread])


def shrunk_beta(
    df: DataFrame, window: int = 60, task_rows: int | None = None, source: DataFrame | None = None
) -> DataFrame:
    """Beta to the market, shrunk towards 1 by cross-sectional against estimation variance.

    The estimation variance is filled backwards: from the code's own later rows, then from the first
    value of the next code in code order, then 0.25. source: the same rows with fewer columns, read for
    the two side tables (one row per day, one per code). When not given, df itself is read for them; it is written
    once, and the result is no longer partitioned on the code.
    """
    kept = df.columns
    df = _raw_and_variance(df, window)
    down = Window.partitionBy(CODE).orderBy(F.col(DATE).desc()).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__own", F.last("est", ignorenulls=True).over(down))
    if source is None:
        # Written, so that the rolling sums are made once for the rows and the side tables.
        # A code's first __own is its first known variance, so that the variance itself need not be kept.
        df = save(df.select(*kept, "raw", "__own"), "betas")
        side, known = df, "__own"
    else:
        side, known = save(_raw_and_variance(source, window).select(CODE, DATE, "raw", "est"), "betas"), "est"
    across = side.groupBy(DATE).agg(F.var_samp("raw").alias("__across"))
    ahead = next_code_value(side.select(CODE, DATE, known), known, task_rows)
    if source is None:
        # Only rows without a later value of their own need the next code's.
        alone = df.filter(F.col("__own").isNull()).join(ahead, CODE, "left")
        df = df.filter(F.col("__own").isNotNull()).withColumn("__next", F.lit(None).cast("double")).unionByName(alone)
    else:
        df = df.join(ahead, CODE, "left")
    df = df.join(F.broadcast(across), DATE, "left")  # one row per calendar day
    ev = F.coalesce("__own", "__next", lit(0.25))
    cv = fill(F.col("__across"), 0)
    w = clip(cv / (cv + ev + lit(1e-9)), 0, 1)
    beta = fill(clip(w * F.col("raw") + (lit(1) - w), -5, 5), 1)
    return drop_private(df.withColumn("beta", beta)).drop("raw", "est")
