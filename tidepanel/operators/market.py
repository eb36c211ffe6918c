"""Market returns derived from the index carried in the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.num import div_ieee, fill, lit
from tidepanel.functions.windows import CODE, DATE


def market_series(df: DataFrame) -> DataFrame:
    """date, market_return, market_return_fwd; one row per calendar day, so one ordered task is enough.

    market_return is the relative change of the day's index, which is that of the first code that has one (gaps are
    padded first); the forward return is the next day's.
    """
    known = F.when(F.col("market_index").isNotNull(), F.col(CODE))
    w = Window.partitionBy(F.lit(1)).orderBy(DATE)
    day = df.groupBy(DATE).agg(F.min_by("market_index", known).alias("__i"))
    padded = F.last("__i", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    day = day.withColumn("__p", padded)
    day = day.withColumn("market_return", div_ieee(F.col("__p"), F.lag("__p").over(w)) - 1)
    return day.withColumn("market_return_fwd", F.lead("market_return").over(w)).select(DATE, "market_return", "market_return_fwd")


def add_market_returns(df: DataFrame) -> DataFrame:
    """Join the market series onto the panel; nulls become 0; without an index both are 0."""
    if "market_index" not in df.columns:
        return df.withColumns({"market_return": lit(0), "market_return_fwd": lit(0)})
    return join_market_returns(df, market_series(df))


def join_market_returns(df: DataFrame, days: DataFrame) -> DataFrame:
    """Join a market series, one row per calendar day; nulls become 0."""
    joined = df.join(F.broadcast(days), DATE, "left")
    return joined.withColumns({c: fill(F.col(c), 0) for c in ("market_return", "market_return_fwd")})
