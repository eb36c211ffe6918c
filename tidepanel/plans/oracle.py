"""ANSI SQL stating each registered query independently, for DuckDB over the given tables."""

from __future__ import annotations

from tidepanel.functions.num import CANON_SHIFT


def c(x: str, d: int = 6) -> str:
    """Rounding used on both sides; see functions.num.canon."""
    return f"(round(({x}) * 1e{d} + {CANON_SHIFT!r}) / 1e{d} + 0.0)"


def fill(x: str, v: float) -> str:
    return f"coalesce({x}, CAST({v} AS DOUBLE))"


def clip(x: str, lo: float | None = None, hi: float | None = None) -> str:
    y = x
    if lo is not None:
        y = f"greatest({y}, CAST({lo} AS DOUBLE))"
    if hi is not None:
        y = f"least({y}, CAST({hi} AS DOUBLE))"
    return f"(CASE WHEN ({x}) IS NOT NULL THEN {y} END)"


PANEL = f"""
li AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS code, CAST(l_shipdate AS DATE) AS date,
         100 + l_extendedprice / 10000 AS px, l_quantity AS q, * FROM lineitem),
bar AS (
  SELECT code, date,
    first(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open,
    max(px) AS high, min(px) AS low,
    last(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close,
    sum(q) AS volume, {c("sum(l_extendedprice)", 2)} AS amount,
    sum(CASE l_returnflag WHEN 'A' THEN q WHEN 'R' THEN -q ELSE 0 END) AS fii_net,
    sum(CASE l_linestatus WHEN 'O' THEN q ELSE -q END) AS dealer_net,
    sum(CASE WHEN l_linenumber % 2 = 0 THEN q ELSE -q END) AS trust_net,
    {c("sum(q * l_discount)")} AS margin_buy, {c("sum(q * l_tax)")} AS margin_sell,
    {c("sum(q * (1 - l_discount))")} AS margin_balance, {c("sum(l_discount) / count(*) * 100")} AS margin_util,
    {c("sum(l_tax) / count(*) * 100")} AS fii_investable,
    sum(CASE l_returnflag WHEN 'R' THEN q ELSE 0 END) AS sl_sell_balance,
    sum(CASE WHEN l_linenumber = 1 THEN q ELSE 0 END) AS intraday_shares,
    max(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS margin_suspension
  FROM li GROUP BY code, date),
macro AS (
  SELECT date, {c("sum(l_extendedprice) / sum(q)")} AS market_index, {c("sum(l_discount) / count(*) * 100")} AS intraday_sell_pct
  FROM li GROUP BY date),
mon AS (SELECT code, date_trunc('month', date) AS m, {c("sum(l_extendedprice)", 2)} AS rev FROM li GROUP BY 1, 2),
qtr AS (SELECT code, date_trunc('quarter', date) AS k, {c("sum(l_extendedprice * (1 - l_discount))", 4)} AS net,
               {c("sum(l_extendedprice * (1 - l_discount) * (1 + l_tax))")} AS gross FROM li GROUP BY 1, 2),
yr AS (SELECT code, year(date) AS y, {c("sum(l_extendedprice)", 2)} AS rev FROM li GROUP BY 1, 2),
panel AS MATERIALIZED (
  SELECT b.code, b.date, b.open, high, low, close, volume, amount, fii_net, dealer_net, trust_net,
    margin_buy, margin_sell, margin_balance, margin_util, margin_sell * 2 AS ms_balance, volume AS ms_limit,
    volume * 100 AS fii_shares, volume * 10 AS insider_shares, fii_investable,
    sl_sell_balance, volume AS sl_balance, intraday_shares, margin_suspension,
    CAST(0.95 AS DOUBLE) * close AS adj_close, CAST(0.95 AS DOUBLE) * open AS adj_open, market_index, intraday_sell_pct,
    s_acctbal * 100 AS market_value, s_acctbal * 1000 AS equity, close / (s_acctbal + 1000) AS pbr,
    m1.rev AS monthly_revenue, (m1.rev / m2.rev - 1) * 100 AS monthly_revenue_mom,
    y1.rev AS monthly_revenue_ly_cum, q1.net / 1e6 AS eps, q1.gross AS pretax_profit
  FROM bar b JOIN macro USING (date)
  JOIN supplier s ON CAST(s_suppkey AS VARCHAR) = b.code
  LEFT JOIN mon m1 ON m1.code = b.code AND m1.m = date_trunc('month', b.date) - INTERVAL 1 MONTH
  LEFT JOIN mon m2 ON m2.code = b.code AND m2.m = date_trunc('month', b.date) - INTERVAL 2 MONTH
  LEFT JOIN qtr q1 ON q1.code = b.code AND q1.k = date_trunc('quarter', b.date) - INTERVAL 3 MONTH
  LEFT JOIN yr y1 ON y1.code = b.code AND y1.y = year(b.date) - 1)
"""


def q(body: str, *ctes: str) -> str:
    """WITH RECURSIVE over the panel, further CTEs, then the body."""
    return "WITH RECURSIVE " + ",\n".join([PANEL, *ctes]) + "\n" + body
