"""Forward-return labels: buy at the next open, sell at the one after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.num import clip, lit, ratio
from tidepanel.functions.ordered import exact_quantile
from tidepanel.functions.windows import lead


def _tick(x: Column, above: float) -> Column:
    return F.when(x.isNotNull(), F.when(x > above, 1).otherwise(0))


def forward_return(df: DataFrame, bound: float = 0.15) -> DataFrame:
    t1, t2 = lead(F.col("adj_open"), 1), lead(F.col("adj_open"), 2)
    return df.withColumn("return", clip(ratio(t2 - t1, t1), -bound, bound))


def add_labels(df: DataFrame, bound: float = 0.15, tick: float = 0.01, tick0: float = 0.0) -> DataFrame:
    return label_returns(forward_return(df, bound), bound, tick, tick0)


def label_returns(df: DataFrame, bound: float = 0.15, tick: float = 0.01, tick0: float = 0.0) -> DataFrame:
    """Labels of rows that have their forward return; no row needs another."""
    excess = clip(F.col("return") - F.col("beta") * F.col("market_return_fwd"), -bound, bound)
    df = df.withColumn("excess_return", excess)
    return df.withColumns(
        {
            "return_tick": _tick(F.col("return"), tick),
            "return_tick_0": _tick(F.col("return"), tick0),
            "excess_return_tick": _tick(F.col("excess_return"), tick),
        }
    )


def label_extract(df: DataFrame) -> DataFrame | None:
    """The label columns alone; None when one is missing."""
    cols = ["code", "date", "return", "excess_return", "beta"]
    return df.select(*cols) if all(c in df.columns for c in cols) else None


def positive_rates(df: DataFrame) -> DataFrame:
    """Share of ones among the non-null labels."""
    names = ["return_tick", "return_tick_0", "excess_return_tick"]
    return df.agg(*[F.avg(F.col(n).cast("double")).alias(f"{n}_rate") for n in names])


def label_histogram(df: DataFrame, label: str, bins: int = 100, task_rows: int | None = None) -> DataFrame:
    """Equal-width histogram between min and max (last bin closed), with mean and exact median."""
    x = F.col(label)
    df = df.filter(x.isNotNull()).select(label)
    # Both one-row tables ride along with the bins, not with the rows.
    edges = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mean"), F.count(x).alias("n"))
    median = exact_quantile(df, [], label, 0.5, "median", task_rows)
    one = edges.withColumn("__k", F.lit(1))
    width = (F.col("hi") - F.col("lo")) / lit(bins)
    pos = F.floor((x - F.col("lo")) / F.when(width > 0, width)).cast("int")
    placed = df.withColumn("__k", F.lit(1)).join(F.broadcast(one), "__k")
    bin_no = F.least(F.coalesce(pos, F.lit(bins // 2)), F.lit(bins - 1))
    counts = placed.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))
    full = one.select("__k", "lo", "hi", "mean", "n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = full.join(counts, "bin", "left").join(median.withColumn("__k", F.lit(1)), "__k")
    return full.select(
        F.lit(label).alias("label"),
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_low"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        "mean",
        "median",
    )


def label_value_counts(df: DataFrame, labels: list[str]) -> DataFrame:
    """Counts and shares of each value of the tick labels."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).cast("int").alias("value")) for n in labels])).alias("p"))
    counts = long.select("p.*").filter("value is not null").groupBy("label", "value").agg(F.count(F.lit(1)).alias("n_rows"))
    total = F.sum("n_rows").over(Window.partitionBy("label"))
    return counts.withColumn("share", F.col("n_rows") / total)
