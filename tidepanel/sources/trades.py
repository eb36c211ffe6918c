"""Daily bars from trade lines: the (code, date) panel built from lineitem and supplier.

One shuffle on the entity carries everything: the lines are exchanged on it before they are added up, which is less than the
wide bars that they make, and figures of earlier months, quarters and years are range frames over the bars instead of self joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions.num import canon, lit, safe_div
from tidepanel.functions.ordered import TASK_ROWS, group_sizes
from tidepanel.functions.windows import TASK_BYTES, exchange_parts

PANEL_COLUMNS = [
    "code", "date", "open", "high", "low", "close", "volume", "amount",
    "fii_net", "dealer_net", "trust_net", "margin_buy", "margin_sell", "margin_balance", "margin_util",
    "ms_balance", "ms_limit", "fii_shares", "insider_shares", "fii_investable",
    "sl_sell_balance", "sl_balance", "intraday_shares", "margin_suspension",
    "adj_close", "adj_open", "market_index", "intraday_sell_pct", "market_value", "equity", "pbr",
    "monthly_revenue", "monthly_revenue_mom", "monthly_revenue_ly_cum", "eps", "pretax_profit",
]


# Sums of doubles depend on the order of the rows; rounding makes the panel reproducible.
_num = canon


def _bars(lines: DataFrame) -> DataFrame:
    q, price = F.col("l_quantity"), F.col("l_extendedprice")
    disc, tax = F.col("l_discount"), F.col("l_tax")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    px = lit(100) + price / lit(10000)
    turn = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    signed = F.when(flag == "A", q).when(flag == "R", -q).otherwise(lit(0))
    return lines.groupBy("code", F.to_date("l_shipdate").alias("date")).agg(
        F.min_by(px, turn).alias("open"),
        F.max(px).alias("high"),
        F.min(px).alias("low"),
        F.max_by(px, turn).alias("close"),
        F.sum(q).alias("volume"),
        _num(F.sum(price), 2).alias("amount"),
        F.sum(signed).alias("fii_net"),
        F.sum(F.when(status == "O", q).otherwise(-q)).alias("dealer_net"),
        F.sum(F.when(F.col("l_linenumber") % 2 == 0, q).otherwise(-q)).alias("trust_net"),
        _num(F.sum(q * disc)).alias("margin_buy"),
        _num(F.sum(q * tax)).alias("margin_sell"),
        _num(F.sum(q * (lit(1) - disc))).alias("margin_balance"),
        F.sum(disc).alias("__disc"),
        F.sum(tax).alias("__tax"),
        F.count(F.lit(1)).alias("__n"),
        F.sum(F.when(flag == "R", q).otherwise(lit(0))).alias("sl_sell_balance"),
        F.sum(F.when(F.col("l_linenumber") == 1, q).otherwise(lit(0))).alias("intraday_shares"),
        F.max(F.when((flag == "R") & (status == "F"), lit(1)).otherwise(lit(0))).alias("margin_suspension"),
        F.sum(price * (lit(1) - disc)).alias("__net"),
        F.sum(price * (lit(1) - disc) * (lit(1) + tax)).alias("__gross"),
    )


def _previous(x: str, index: Column, back: int) -> Column:
    """Sum of x over the rows whose period index is `back` periods before the row's own."""
    w = Window.partitionBy("code").orderBy(index).rangeBetween(-back, -back)
    return F.sum(x).over(w)


def _bars_by_code(lines: DataFrame, task_rows: int | None = None) -> DataFrame:
    """Bars, partitioned on the code. Lines of a code with more than task_rows of them are added up before the exchange."""
    task_rows = TASK_ROWS if task_rows is None else task_rows
    parts = exchange_parts(lines, TASK_BYTES // 4)  # a bar is several times as wide as its lines
    if group_sizes(lines, ["code"])[0] <= task_rows:
        return _bars(lines.repartition(parts, "code"))
    return _bars(lines).repartition(parts, "code")


def build_panel(spark: SparkSession, sf_dir: str, task_rows: int | None = None) -> DataFrame:
    """One row per code and day, partitioned on the code."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("code", F.col("l_suppkey").cast("string"))
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    bars = _bars_by_code(lines, task_rows)
    # At most one row per calendar day: bounded, so the broadcast is safe.
    macro = lines.groupBy(F.to_date("l_shipdate").alias("date")).agg(
        _num(F.sum("l_extendedprice") / F.sum("l_quantity")).alias("market_index"),
        _num(F.sum("l_discount") / F.count(F.lit(1)) * 100).alias("intraday_sell_pct"),
    )
    year, month = F.year("date"), F.month("date")
    m, qtr = year * 12 + month, year * 4 + F.quarter("date")
    bars = bars.withColumns(
        {
            "__m1": _num(_previous("amount", m, 1), 2),
            "__m2": _num(_previous("amount", m, 2), 2),
            "__q_net": _num(_previous("__net", qtr, 1), 4),
            "__q_gross": _num(_previous("__gross", qtr, 1), 6),
            "__y1": _num(_previous("amount", year, 1), 2),
        }
    )
    bal = supplier.select(F.col("s_suppkey").cast("string").alias("code"), F.col("s_acctbal").alias("__bal"))
    close, q = F.col("close"), F.col("volume")
    return (
        bars.join(bal, "code")
        .join(F.broadcast(macro), "date")
        .withColumns(
            {
                "margin_util": _num(F.col("__disc") / F.col("__n") * 100),
                "fii_investable": _num(F.col("__tax") / F.col("__n") * 100),
                "ms_balance": F.col("margin_sell") * 2,
                "ms_limit": q,
                "fii_shares": q * 100,
                "insider_shares": q * 10,
                "sl_balance": q,
                "adj_close": lit(0.95) * close,
                "adj_open": lit(0.95) * F.col("open"),
                "market_value": F.col("__bal") * 100,
                "equity": F.col("__bal") * 1000,
                "pbr": close / (F.col("__bal") + 1000),
                "monthly_revenue": F.col("__m1"),
                "monthly_revenue_mom": (safe_div(F.col("__m1"), F.col("__m2")) - 1) * 100,
                "monthly_revenue_ly_cum": F.col("__y1"),
                "eps": F.col("__q_net") / lit(1e6),
                "pretax_profit": F.col("__q_gross"),
            }
        )
        .select(*PANEL_COLUMNS)
    )
