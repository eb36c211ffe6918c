"""Decile portfolios: daily returns, performance, benchmark and cumulative series.

After the daily decile means only dates x (groups + 2) rows remain. These series tables are kept long
(series, date, ret), so ordered windows are partitioned by series.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.num import lit, safe_div
from tidepanel.functions.windows import DATE, drop_private

ANNUAL_DAYS = 252


def decile_counts(df: DataFrame) -> DataFrame:
    return df.filter(F.col("decile").isNotNull()).groupBy("decile").agg(F.count(F.lit(1)).alias("n_rows"))


def decile_daily_returns(df: DataFrame, cost_bps: float = 0, capital_usage: float = 1.0) -> DataFrame:
    """date, decile, ret: mean return of each group and day, less round-trip cost, times the capital used."""
    cost = cost_bps / 10_000 * 2
    mean = F.avg("return")
    days = df.filter(F.col("decile").isNotNull()).groupBy(DATE, "decile").agg(mean.alias("__m"))
    return days.select(DATE, "decile", ((F.col("__m") - lit(cost)) * lit(capital_usage)).alias("ret"))


def decile_table(daily: DataFrame, n: int = 10) -> DataFrame:
    """Wide form: date, D1..Dn."""
    wide = daily.groupBy(DATE).pivot("decile", list(range(1, n + 1))).agg(F.first("ret"))
    return wide.withColumnsRenamed({str(i): f"D{i}" for i in range(1, n + 1)})


def with_benchmark(wide: DataFrame, market: DataFrame, value: str = "market_return_fwd") -> DataFrame:
    """Adds market (NULL on days without one) and excess_D1 = D1 - market."""
    bench = market.select(DATE, F.col(value).alias("market"))
    out = wide.join(F.broadcast(bench), DATE, "left")  # one row per calendar day
    return out.withColumn("excess_D1", F.col("D1") - F.col("market"))


def to_long(wide: DataFrame) -> DataFrame:
    """series, date, ret."""
    names = [c for c in wide.columns if c != DATE]
    return wide.unpivot([DATE], names, "series", "ret").select("series", DATE, "ret")


def along(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy(DATE)


def nav(x: Column, key: str = "series") -> Column:
    """Running product of 1 + x, a missing day counting as 0."""
    w = along(key).rowsBetween(Window.unboundedPreceding, 0)
    return F.product(lit(1) + F.coalesce(x, lit(0))).over(w)


def performance_metrics(long: DataFrame, annual_days: int = ANNUAL_DAYS) -> DataFrame:
    """One row per series: annual return and deviation, Sharpe, drawdown, Calmar, hit rate, days.

    The drawdown is taken from the running peak of the value after the first day, not from 1.
    """
    r = F.col("ret")
    full = long.filter(r.isNotNull()).withColumn("__nav", nav(r))
    upto = along("series").rowsBetween(Window.unboundedPreceding, 0)
    full = full.withColumn("__peak", F.max("__nav").over(upto))
    agg = full.groupBy("series").agg(
        F.product(lit(1) + r).alias("__growth"),
        F.stddev_samp(r).alias("__std"),
        F.min((F.col("__nav") - F.col("__peak")) / F.col("__peak")).alias("mdd"),
        F.avg((r > 0).cast("double")).alias("hit_rate"),
        F.count(r).alias("n_days"),
    )
    agg = agg.withColumns(
        {
            "ann_return": F.pow(F.col("__growth"), lit(annual_days) / F.col("n_days")) - 1,
            "ann_std": F.col("__std") * lit(math.sqrt(annual_days)),
        }
    )
    std, mdd = F.col("ann_std"), F.col("mdd")
    out = agg.withColumns(
        {
            "sharpe": F.when(std > 0, F.col("ann_return") / F.when(std > 0, std)),
            "calmar": F.when(mdd != 0, F.col("ann_return") / F.abs(F.when(mdd != 0, mdd))),
        }
    )
    return out.select("series", "ann_return", "ann_std", "sharpe", "mdd", "calmar", "hit_rate", "n_days")


def alpha_ir(long: DataFrame, annual_days: int = ANNUAL_DAYS) -> DataFrame:
    """Alpha and information ratio of each decile series, given more than 10 days common with the market."""
    market = long.filter("series = 'market' and ret is not null").select(DATE, F.col("ret").alias("mkt"))
    series = long.filter("series not in ('market', 'excess_D1') and ret is not null")
    both = series.join(F.broadcast(market), DATE, "left")  # one row per calendar day
    common = F.col("mkt").isNotNull()
    ex = F.when(common, F.col("ret") - F.col("mkt"))
    agg = both.groupBy("series").agg(
        F.product(lit(1) + F.col("ret")).alias("__g"),
        F.count("ret").alias("__n"),
        F.product(lit(1) + F.col("mkt")).alias("__gm"),
        F.count("mkt").alias("n_common"),
        F.avg(ex).alias("__mean"),
        F.stddev_samp(ex).alias("__std"),
    )
    enough = F.col("n_common") > 10
    some = F.when(F.col("n_common") > 0, F.col("n_common"))
    ann = F.pow(F.col("__g"), lit(annual_days) / F.col("__n")) - 1
    ann_mkt = F.pow(F.col("__gm"), lit(annual_days) / some) - 1
    te = F.col("__std") * lit(math.sqrt(annual_days))
    return agg.select(
        "series",
        "n_common",
        F.when(enough, ann - ann_mkt).alias("alpha"),
        F.when(enough & (te > 0), F.col("__mean") * annual_days / F.when(te > 0, te)).alias("ir"),
    )


def annual_returns(wide: DataFrame, series: str = "D1", market: str = "market") -> DataFrame:
    """Compound return per calendar year of the series and, where it has days, of the market."""
    year = F.year(DATE).alias("year")
    s = wide.filter(F.col(series).isNotNull()).groupBy(year).agg((F.product(lit(1) + F.col(series)) - 1).alias("strategy"))
    m = wide.filter(F.col(market).isNotNull()).groupBy(year).agg((F.product(lit(1) + F.col(market)) - 1).alias("market"))
    return s.join(m, "year")


def cumulative_nav(long: DataFrame) -> DataFrame:
    """Value of 1 invested and its base-10 logarithm, per series and day."""
    out = long.withColumn("nav", nav(F.col("ret")))
    return out.withColumn("log10_nav", F.log10(F.when(F.col("nav") > 0, F.col("nav")))).drop("ret")


def decile_summary(metrics: DataFrame) -> DataFrame:
    """Log annual return and Sharpe ratio of the groups and the market."""
    kept = metrics.filter("series != 'excess_D1'")
    floored = F.greatest(F.col("ann_return"), lit(-0.999))
    return kept.select("series", F.log1p(floored).alias("ln_ann_return"), "sharpe")


def strategy_beta(
    series: DataFrame, mode: str = "rolling", window: int = 252, least: int = 60
) -> DataFrame:
    """date, beta of the strategy (column s) to the market (column m); one row per calendar day goes in.

    rolling / expanding use the days before; warm-up takes the first known beta, else 1. "full" is one value for all.
    """
    w = Window.partitionBy(F.lit(1)).orderBy(DATE)
    both = F.col("s").isNotNull() & F.col("m").isNotNull()
    if mode == "full":
        whole = Window.partitionBy(F.lit(1))
        cov = F.covar_samp(F.when(both, F.col("s")), F.when(both, F.col("m"))).over(whole)
        var = F.var_samp(F.when(both, F.col("m"))).over(whole)
        out = series.withColumns({"__cov": cov, "__var": var})
        one = F.when(F.col("__var") > 0, F.col("__cov") / F.when(F.col("__var") > 0, F.col("__var"))).otherwise(lit(1))
        return out.select(DATE, one.alias("beta"))
    frame = w.rowsBetween(Window.unboundedPreceding if mode == "expanding" else -(window - 1), 0)
    pair = series.filter(both)
    pair = pair.withColumns(
        {
            "__n": F.count("s").over(frame),
            "__cov": F.covar_samp("s", "m").over(frame),
            "__var": F.var_samp("m").over(frame),
        }
    )
    raw = F.when(F.col("__n") >= least, safe_div(F.col("__cov"), F.col("__var")))
    pair = pair.withColumn("__raw", raw).select(DATE, F.lag("__raw").over(w).alias("__beta"))
    out = series.select(DATE).join(pair, DATE, "left")
    # Newest day first, so that "the next known beta" is a growing frame.
    ahead = Window.partitionBy(F.lit(1)).orderBy(F.col(DATE).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return out.select(DATE, F.coalesce(F.last("__beta", ignorenulls=True).over(ahead), lit(1)).alias("beta"))


def beta_neutral_excess(series: DataFrame, **kwargs) -> DataFrame:
    """date, beta, excess = s - beta * m."""
    beta = strategy_beta(series, **kwargs)
    out = series.join(beta, DATE)
    return out.select(DATE, "beta", (F.col("s") - F.col("beta") * F.col("m")).alias("excess"))


def relative_nav(series: DataFrame) -> DataFrame:
    """Strategy value over market value on common days, and its drawdown from the running peak."""
    w = Window.partitionBy(F.lit(1)).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    both = series.filter("s is not null and m is not null")
    s, m = F.product(lit(1) + F.col("s")).over(w), F.product(lit(1) + F.col("m")).over(w)
    both = both.withColumns({"__s": s, "__m": m})
    both = both.withColumn("rel", F.col("__s") / F.col("__m"))
    both = both.withColumn("__peak", F.max("rel").over(w))
    return drop_private(both.withColumn("dd", F.col("rel") / F.col("__peak") - 1)).select(DATE, "rel", "dd")


def drawdown_curve(series: DataFrame) -> DataFrame:
    """Underwater curve of the strategy; a missing day counts as 0."""
    w = Window.partitionBy(F.lit(1)).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    out = series.withColumn("__nav", F.product(lit(1) + F.coalesce(F.col("s"), lit(0))).over(w))
    out = out.withColumn("__peak", F.max("__nav").over(w))
    return out.select(DATE, ((F.col("__nav") - F.col("__peak")) / F.col("__peak")).alias("dd"))


def drawdown_episodes(curve: DataFrame, tol: float = 1e-12) -> DataFrame:
    """Maximal runs below water of a drawdown curve (date, dd).

    Every at-water day opens an island; the days below water that follow belong to it. The peak is the island's
    at-water day, the recovery the next at-water day, missing while the run is still open.
    """
    w = Window.partitionBy(F.lit(1)).orderBy(DATE)
    under = F.col("dd") < lit(-tol)
    marked = curve.withColumn("__under", under).withColumns(
        {
            "__isl": F.sum(F.when(F.col("__under"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "__last": F.max(DATE).over(Window.partitionBy(F.lit(1))),
        }
    )
    below = F.col("__under")
    isl = marked.groupBy("__isl").agg(
        F.min(DATE).alias("peak"),
        F.min_by(F.when(below, F.col(DATE)), F.when(below, F.struct("dd", DATE))).alias("trough"),
        F.min(F.when(below, F.col("dd"))).alias("depth"),
        F.max(F.when(~below, 1)).alias("__has_water"),
        F.max("__last").alias("__last"),
    )
    nxt = Window.partitionBy(F.lit(1)).orderBy("__isl")
    isl = isl.withColumn("recovery", F.lead("peak").over(nxt)).filter(F.col("depth").isNotNull())
    end = F.coalesce("recovery", "__last")
    return isl.select(
        "peak",
        "trough",
        "recovery",
        "depth",
        F.datediff("trough", "peak").alias("days_to_trough"),
        F.datediff(end, F.col("peak")).alias("days_underwater"),
        F.col("recovery").isNull().alias("ongoing"),
    )


def drawdown_topk(episodes: DataFrame, k: int = 5) -> DataFrame:
    """The k deepest episodes, with flags for the deepest and the longest of all."""
    w = Window.partitionBy(F.lit(1))
    deepest_first, longest_first = ["depth", "peak"], [F.col("days_underwater").desc(), "depth", "peak"]
    ranked = episodes.withColumns(
        {
            "rank": F.row_number().over(w.orderBy(*deepest_first)),
            "__longest": F.row_number().over(w.orderBy(*longest_first)) == 1,
        }
    )
    out = ranked.filter((F.col("rank") <= k) | F.col("__longest"))
    return out.select("rank", "peak", "trough", "recovery", "depth", "days_underwater", F.col("__longest").alias("longest"))
