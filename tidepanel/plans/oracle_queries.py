"""SQL counterparts of the registered queries."""

from __future__ import annotations

from tidepanel.plans.catalog import DECILES, FIRST_YEAR, LAST_YEAR, STEP_COLUMNS, digits_of
from tidepanel.plans.oracle import c, clip, fill, q
from tidepanel.sources.trades import PANEL_COLUMNS

ORACLE: dict[str, str] = {}

E = "(PARTITION BY code ORDER BY date)"
UPTO = "(PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
PRIOR = "(PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
AHEAD = "(PARTITION BY code ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
DAYS_UPTO = "(ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def num(v: float) -> str:
    """A DOUBLE literal."""
    return f"CAST({v!r} AS DOUBLE)"


def rows(w: int) -> str:
    return f"(PARTITION BY code ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, w: int, least: int, *cols: str) -> str:
    some = " AND ".join(f"({x}) IS NOT NULL" for x in cols)
    return (
        f"CASE WHEN count(CASE WHEN {some} THEN 1 END) OVER {rows(w)} >= {least} "
        f"THEN {agg}({', '.join(cols)}) OVER {rows(w)} END"
    )


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER {E}"


def eps(a: str, b: str) -> str:
    return f"(({a}) / (({b}) + 1e-9))"


def ieee(a: str, b: str) -> str:
    return (
        f"(CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) WHEN ({b}) = 0 AND ({a}) > 0 THEN CAST('inf' AS DOUBLE) "
        f"WHEN ({b}) = 0 AND ({a}) < 0 THEN CAST('-inf' AS DOUBLE) END)"
    )


def to_date_in(unit: str) -> str:
    return f"(PARTITION BY code, date_trunc('{unit}', date) ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def whole(unit: str) -> str:
    return (
        f"(PARTITION BY code, date_trunc('{unit}', date) ORDER BY date "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    )


def sel(keys: str, cols: dict[str, str]) -> str:
    made = [f"{c(x, digits_of(n))} AS {n}" for n, x in cols.items()]
    return ", ".join([keys, *made] if keys else made)


def plain(names: list[str]) -> dict[str, str]:
    return {n: n for n in names}


def panel_query(name: str, cols: dict[str, str], src: str = "panel", *ctes: str) -> None:
    ORACLE[name] = q(f"SELECT {sel('code, date', cols)} FROM {src}", *ctes)


def recur(name: str, src: str, first: dict[str, str], nxt: dict[str, str], start: int = 1) -> str:
    """Row-by-row recurrence over src(code, rn, ...): values of row `start`, then of each next row (s) from the last (r)."""
    a = ", ".join(f"{x} AS {n}" for n, x in first.items())
    b = ", ".join(nxt[n] for n in first)
    return (
        f"{name} AS (SELECT s.code, s.rn, {a} FROM {src} s WHERE s.rn = {start} UNION ALL "
        f"SELECT s.code, s.rn, {b} FROM {name} r JOIN {src} s ON s.code = r.code AND s.rn = r.rn + 1)"
    )


MARKET = (
    "mday AS (SELECT DISTINCT date, market_index FROM panel)",
    f"mret AS (SELECT date, {ieee('market_index', 'lag(market_index) OVER (ORDER BY date)')} - 1 AS mr FROM mday)",
    "mkt AS MATERIALIZED (SELECT date, mr AS market_return, lead(mr) OVER (ORDER BY date) AS market_return_fwd FROM mret)",
    "mp AS MATERIALIZED (SELECT p.*, coalesce(m.market_return, 0) AS market_return, "
    "coalesce(m.market_return_fwd, 0) AS market_return_fwd FROM panel p LEFT JOIN mkt m USING (date))",
    f"dr AS MATERIALIZED (SELECT *, {fill(ieee('adj_close', lag('adj_close')) + ' - 1', 0)} AS daily_return FROM mp)",
)


def beta_raw(w: int, least: int) -> str:
    cov = roll("covar_samp", w, least, "daily_return", "market_return")
    var = roll("var_samp", w, least, "market_return")
    return clip(f"(({cov}) / (({var}) + 1e-9))", -5, 5)


BETA = (
    *MARKET,
    f"b1 AS MATERIALIZED (SELECT *, {beta_raw(60, 30)} AS raw, "
    f"{fill(roll('stddev_samp', 20, 10, 'daily_return') + f' * sqrt({num(252)})', 0)} AS vol20 FROM dr)",
    f"b2 AS MATERIALIZED (SELECT *, pow({roll('stddev_samp', 60, 30, 'raw')}, 2) AS est FROM b1)",
    "own AS (SELECT code, arg_min(est, date) FILTER (est IS NOT NULL) AS own FROM b2 GROUP BY code)",
    "nxt AS (SELECT code, first_value(own IGNORE NULLS) OVER (ORDER BY code ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) "
    "AS nx FROM own)",
    "crs AS (SELECT date, var_samp(raw) AS cv FROM b2 GROUP BY date)",
    f"b3 AS (SELECT b2.*, coalesce(cv, 0) AS cv, coalesce(first_value(est IGNORE NULLS) OVER {AHEAD.replace('code ', 'b2.code ').replace('BY date', 'BY b2.date')}, nx, {num(0.25)}) AS ev "
    "FROM b2 JOIN nxt ON nxt.code = b2.code JOIN crs ON crs.date = b2.date)",
    f"b4 AS (SELECT *, {clip('cv / (cv + ev + 1e-9)', 0, 1)} AS w FROM b3)",
    f"lb AS MATERIALIZED (SELECT *, {fill(clip('(w * raw + (1 - w))', -5, 5), 1)} AS beta FROM b4)",
    f"lr AS (SELECT *, {clip(f'((lead(adj_open, 2) OVER {E} - lead(adj_open, 1) OVER {E}) / (lead(adj_open, 1) OVER {E} + 1e-9))', -0.15, 0.15)} AS return FROM lb)",
    f"le AS (SELECT *, {clip('(return - beta * market_return_fwd)', -0.15, 0.15)} AS excess_return FROM lr)",
    "labelled AS MATERIALIZED (SELECT *, "
    + ", ".join(
        f"CASE WHEN {x} IS NOT NULL THEN CASE WHEN {x} > {num(t)} THEN 1 ELSE 0 END END AS {n}"
        for n, x, t in (
            ("return_tick", "return", 0.01),
            ("return_tick_0", "return", 0.0),
            ("excess_return_tick", "excess_return", 0.01),
        )
    )
    + " FROM le)",
)

PRED = (
    *BETA,
    f"z0 AS (SELECT *, {num(10)} * (close - open) / open AS z FROM labelled)",
    f"p0 AS (SELECT code, date, return, excess_return_tick AS y_true, "
    f"round({num(0.5)} + {num(0.5)} * z / ({num(1)} + abs(z)), 6) AS y_prob FROM z0)",
    "p1 AS (SELECT *, CASE WHEN y_prob >= 0.5 THEN 1 ELSE 0 END AS y_pred FROM p0)",
    "predictions AS MATERIALIZED (SELECT *, CAST(year(date) - 2 AS VARCHAR) || '_' || CAST(year(date) AS VARCHAR) AS \"window\" FROM p1 "
    "UNION ALL SELECT *, CAST(year(date) - 1 AS VARCHAR) || '_' || CAST(year(date) + 1 AS VARCHAR) FROM p1 "
    f"WHERE year(date) = {LAST_YEAR - 1})",
    "pick AS (SELECT *, row_number() OVER (PARTITION BY code, date ORDER BY \"window\") AS k FROM predictions)",
    "merged AS MATERIALIZED (SELECT * EXCLUDE (k) FROM pick WHERE k = 1)",
    "rk AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY y_prob DESC NULLS LAST, code) AS rk, "
    "count(y_prob) OVER (PARTITION BY date) AS size FROM merged)",
    "ranked AS MATERIALIZED (SELECT *, CASE WHEN y_prob IS NOT NULL AND size >= 10 THEN CAST(greatest(least(ceil("
    "CAST(rk AS DOUBLE) / CAST(size AS DOUBLE) * 10), 10), 1) AS INTEGER) END AS decile FROM rk)",
)


def decile_pivot(expr: str) -> str:
    return ", ".join(f"max(CASE WHEN decile = {i} THEN {expr} END) AS D{i}" for i in range(1, 11))


SERIES = (
    *PRED,
    "dm AS (SELECT date, decile, avg(return) AS r FROM ranked WHERE decile IS NOT NULL GROUP BY date, decile)",
    f"dw AS (SELECT date, {decile_pivot('r')} FROM dm GROUP BY date)",
    "series AS MATERIALIZED (SELECT dw.*, m.market_return_fwd AS market, D1 - m.market_return_fwd AS excess_D1 "
    "FROM dw LEFT JOIN mkt m USING (date))",
    "long AS MATERIALIZED (SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{s}' AS series, date, {s} AS ret FROM series" for s in [*DECILES, "market", "excess_D1"])
    + "))",
    "pair AS MATERIALIZED (SELECT date, D1 AS s, market AS m FROM series)",
)
SERIES_UPTO = "(PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

METRICS = (
    *SERIES,
    f"nv AS (SELECT *, product(1 + ret) OVER {SERIES_UPTO} AS nav FROM long WHERE ret IS NOT NULL)",
    f"pk AS (SELECT *, max(nav) OVER {SERIES_UPTO} AS peak FROM nv)",
    "pm AS (SELECT series, product(1 + ret) AS g, stddev_samp(ret) AS sd, min((nav - peak) / peak) AS mdd, "
    "avg(CASE WHEN ret > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS hit_rate, count(*) AS n_days FROM pk GROUP BY series)",
    f"px AS (SELECT *, pow(g, {num(252)} / n_days) - 1 AS ann_return, sd * sqrt({num(252)}) AS ann_std FROM pm)",
    "perf AS MATERIALIZED (SELECT *, CASE WHEN ann_std > 0 THEN ann_return / ann_std END AS sharpe, "
    "CASE WHEN mdd <> 0 THEN ann_return / abs(mdd) END AS calmar FROM px)",
)

REL = (
    *SERIES,
    f"r1 AS (SELECT date, product(1 + s) OVER {DAYS_UPTO} AS sn, product(1 + m) OVER {DAYS_UPTO} AS mn FROM pair "
    "WHERE s IS NOT NULL AND m IS NOT NULL)",
    "r2 AS (SELECT date, sn / mn AS rel FROM r1)",
    f"rel AS MATERIALIZED (SELECT date, rel, rel / (max(rel) OVER {DAYS_UPTO}) - 1 AS dd FROM r2)",
    f"w1 AS (SELECT *, dd < -1e-12 AS below, sum(CASE WHEN dd < -1e-12 THEN 0 ELSE 1 END) OVER {DAYS_UPTO} AS isl, "
    "max(date) OVER () AS last FROM rel)",
    "w2 AS (SELECT isl, min(date) AS peak, min(dd) FILTER (below) AS depth, max(last) AS last FROM w1 GROUP BY isl)",
    "w3 AS (SELECT *, lead(peak) OVER (ORDER BY isl) AS recovery FROM w2)",
    "w4 AS (SELECT w3.*, (SELECT min(date) FROM w1 WHERE w1.isl = w3.isl AND w1.dd = w3.depth) AS trough FROM w3 "
    "WHERE depth IS NOT NULL)",
    "episodes AS MATERIALIZED (SELECT peak, trough, recovery, depth, CAST(date_diff('day', peak, trough) AS INTEGER) AS days_to_trough, "
    "CAST(date_diff('day', peak, coalesce(recovery, last)) AS INTEGER) AS days_underwater, recovery IS NULL AS ongoing FROM w4)",
)

# --- sources, sinks, cleaning ---------------------------------------------------------------------------------------

MEASURES = [x for x in PANEL_COLUMNS if x not in ("code", "date")]
panel_query("panel_scan", plain(MEASURES))

MESSY = (
    "ms AS (SELECT code, date, volume, CAST(volume AS BIGINT) AS v, CAST(volume AS BIGINT) + day(date) AS k FROM panel)",
    "messy AS (SELECT code, CAST(date AS VARCHAR) AS date, CASE WHEN k % 7 = 0 THEN 'n/a' ELSE CAST(v AS VARCHAR) END AS x, "
    "CASE WHEN k % 2 = 0 THEN 'bad' ELSE CAST(v AS VARCHAR) END AS y, "
    "CASE WHEN v % 200 = 0 AND day(date) % 2 = 0 THEN '1' END AS junk, volume FROM ms)",
)
ORACLE["panel_coerce"] = q(
    f"SELECT {sel('code, CAST(date AS DATE) AS date', {n: f'TRY_CAST({n} AS DOUBLE)' for n in ('x', 'y', 'junk', 'volume')})} FROM messy",
    *MESSY,
)
ORACLE["latest_date"] = q("SELECT max(date) AS latest_date FROM panel")
WINDOWS = [(s, s + 2) for s in range(FIRST_YEAR, LAST_YEAR - 1)]
PLAN = (
    "wins AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{s}_{e}', {y}, '{'test' if y == e else 'train'}')" for s, e in WINDOWS for y in range(s, e + 1))
    + ') AS t("window", y, role))'
)
ORACLE["window_scan"] = q(
    'SELECT "window", CAST(y AS INTEGER) AS year, count(*) AS n_rows, CAST(sum(excess_return_tick) AS BIGINT) AS n_pos, '
    "max(date) AS last_date FROM labelled JOIN wins ON year(date) = y WHERE excess_return_tick IS NOT NULL GROUP BY 1, 2",
    *BETA,
    PLAN,
)
ORACLE["predictions_merge"] = q(
    f"SELECT code, date, \"window\", {c('return')} AS return, y_true, {c('y_prob')} AS y_prob, y_pred FROM merged", *PRED
)
ORACLE["market_series_fallback"] = q(
    f"SELECT date, {c('median((close - open) / open)')} AS move FROM panel GROUP BY date"
)


def z_ln(x: str) -> str:
    return (
        f"CASE WHEN stddev_samp({x}) OVER (PARTITION BY date) > abs(avg({x}) OVER (PARTITION BY date)) * 1e-14 THEN "
        f"({x} - avg({x}) OVER (PARTITION BY date)) / (stddev_samp({x}) OVER (PARTITION BY date)) END"
    )


def liquidity(src: str) -> tuple[str, ...]:
    w1, w2 = 0.1004, 0.1896
    return (
        f"l1 AS (SELECT *, CASE WHEN amount > 0 THEN ln(amount) END AS la, CASE WHEN market_value > 0 THEN ln(market_value) END AS lm, "
        f"CASE WHEN amount > 0 AND market_value > 0 THEN ln(amount / market_value) END AS lt FROM {src})",
        f"l2 AS (SELECT *, {z_ln('la')} AS z1, {z_ln('lm')} AS z2, {z_ln('lt')} AS z3 FROM l1)",
        f"l3 AS (SELECT *, {num(w1)} * z1 + {num(w2)} * z2 + {num(1.0 - w1 - w2)} * z3 AS liq_score FROM l2)",
        "l4 AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY liq_score DESC NULLS LAST, code) AS lrk, "
        "count(liq_score) OVER (PARTITION BY date) AS lsize FROM l3)",
        "liq AS MATERIALIZED (SELECT *, liq_score IS NOT NULL AND coalesce(CAST(lrk AS DOUBLE) / nullif(lsize, 0) <= "
        f"{num(0.2)}, false) AS liq_keep FROM l4)",
    )


ORACLE["panel_sink_roundtrip"] = q(
    f"SELECT code, date, CAST(year(date) AS INTEGER) AS year, {c('amount', 2)} AS amount, {c('close')} AS close, {c('return')} AS return "
    "FROM liq WHERE liq_keep",
    *BETA,
    *liquidity("labelled"),
)
ORACLE["liquidity_provenance"] = q(
    f"SELECT 'formula3_amount_mv_turnover' AS formula, {c(num(0.1004))} AS w1_amount, {c(num(0.1896))} AS w2_market_value, "
    f"{c(num(0.71))} AS w3_turnover, {c(num(0.2))} AS keep_ratio, 'f3_w101004_w201896_kr02000' AS tag, "
    "count(*) AS rows_before, count(*) FILTER (liq_keep) AS rows_after, "
    f"{c('CAST(count(*) FILTER (liq_keep) AS DOUBLE) / count(*)')} AS kept_share, "
    f"{c('CAST(count(*) FILTER (liq_keep) AS DOUBLE) / (count(DISTINCT date) FILTER (liq_keep))')} AS names_per_day, "
    f"{FIRST_YEAR} AS window_start, {LAST_YEAR} AS window_end FROM liq",
    *liquidity("panel"),
)
ORACLE["label_extract"] = q(f"SELECT {sel('code, date', plain(['return', 'excess_return', 'beta']))} FROM labelled", *BETA)
panel_query("dedup_last", {"close": "CASE WHEN volume > 20 THEN close ELSE close + 1 END", "volume": "volume"})
ORACLE["null_rate_profile"] = q(
    " UNION ALL ".join(
        f"SELECT '{m}' AS \"column\", {c(f'avg(CASE WHEN {m} IS NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)')} AS null_rate FROM panel"
        for m in MEASURES
    )
)
ORACLE["numeric_salvage"] = q(
    'SELECT "column", n_values, n_numeric, coalesce(n_values > 0 AND n_numeric >= 0.8 * n_values, false) AS kept FROM ('
    + " UNION ALL ".join(
        f"SELECT '{m}' AS \"column\", count({m}) AS n_values, count(TRY_CAST({m} AS DOUBLE)) AS n_numeric FROM messy"
        for m in ("x", "y", "junk")
    )
    + ")",
    *MESSY,
)
DENSE = [m for m in MEASURES if m != "adj_close"]


def dense(src: str, measures: list[str]) -> tuple[str, ...]:
    return (
        f"g1 AS (SELECT c.code, d.date, p.* EXCLUDE (code, date) FROM (SELECT DISTINCT code FROM {src}) c "
        f"CROSS JOIN (SELECT DISTINCT date FROM {src}) d LEFT JOIN {src} p ON p.code = c.code AND p.date = d.date)",
        "g2 AS (SELECT *, min(CASE WHEN adj_close IS NOT NULL THEN date END) OVER (PARTITION BY code) AS f FROM g1)",
        f"g3 AS (SELECT code, date, last_value(adj_close IGNORE NULLS) OVER {UPTO} AS adj_close, "
        + ", ".join(f"coalesce(last_value({m} IGNORE NULLS) OVER {UPTO}, 0) AS {m}" for m in measures)
        + " FROM g2 WHERE f IS NULL OR date >= f)",
    )


ORACLE["calendar_densify"] = q(f"SELECT {sel('code, date', {'adj_close': 'adj_close'} | plain(DENSE))} FROM g3", *dense("panel", DENSE))
CLEANED = [*DENSE, "market_return", "market_return_fwd"]
ORACLE["clean_run"] = q(f"SELECT {sel('code, date', {'adj_close': 'adj_close'} | plain(CLEANED))} FROM g3", *MARKET, *dense("mp", CLEANED))
CSV_COLUMNS = ["amount", "adj_close", "vol20", "beta", "return", "excess_return"]
ORACLE["feature_csv_roundtrip"] = q(
    f"SELECT {sel('code, date', plain(CSV_COLUMNS))}, CAST(year(date) AS INTEGER) AS year, CAST(excess_return_tick AS DOUBLE) AS excess_return_tick FROM labelled",
    *BETA,
)
OBV = (
    f"o1 AS (SELECT *, coalesce(sign(adj_close - {lag('adj_close')}) * volume, 0) AS st FROM panel)",
    f"o2 AS (SELECT *, sum(st) OVER {UPTO} AS OBV FROM o1)",
    f"ob AS (SELECT *, {fill(f'''({ieee('OBV', lag('OBV', 5))} - 1) * 100''', 0)} AS OBV_ROC FROM o2)",
)
LEFT_OUT = {"amount", "market_value", "close", "market_index"}
ORACLE["feature_matrix"] = q(
    f"SELECT {sel('code, date', {m: f'coalesce(CASE WHEN isfinite({m}) THEN {m} END, 0)' for m in [*MEASURES, 'OBV', 'OBV_ROC'] if m not in LEFT_OUT})} FROM ob",
    *OBV,
)
ORACLE["walk_forward_split"] = q(
    'SELECT "window", role, count(*) AS n_rows, CAST(sum(excess_return_tick) AS BIGINT) AS n_pos, min(date) AS first_date, '
    "max(date) AS last_date FROM labelled JOIN wins ON year(date) = y WHERE excess_return_tick IS NOT NULL GROUP BY 1, 2",
    *BETA,
    PLAN,
)
ORACLE["liquidity_filter"] = q(f"SELECT code, date, {c('liq_score')} AS liq_score, liq_keep FROM liq", *liquidity("panel"))
ORACLE["cs_zscore"] = q(
    f"SELECT code, date, {c(z_ln('la'))} AS z_ln_amount FROM la",
    "la AS (SELECT code, date, CASE WHEN amount > 0 THEN ln(amount) END AS la FROM panel)",
)
ORACLE["market_returns"] = q(f"SELECT {sel('date', plain(['market_return', 'market_return_fwd']))} FROM mkt", *MARKET)

# --- indicators ------------------------------------------------------------------------------------------------------

TREND = (5, 10, 20, 60, 120, 240)
NUMBERED = f"src AS MATERIALIZED (SELECT code, date, adj_close AS x, row_number() OVER {E} AS rn FROM panel)"


def ema_step(y: str, x: str, a: float) -> str:
    return f"{num(1 - a)} * {y} + {num(a)} * ({x})"


gains = {f"g{w}": "gain" for w in TREND} | {f"l{w}": "loss" for w in TREND}
ORACLE["ta_rsi"] = q(
    "SELECT "
    + sel(
        "d.code, d.date",
        {
            f"RSI_{w}": fill(f"CASE WHEN d.rn > {w} THEN 100 - 100 / (1 + g{w} / (l{w} + 1e-9)) END", -1)
            for w in TREND
        },
    )
    + " FROM d1 d LEFT JOIN rr ON rr.code = d.code AND rr.rn = d.rn",
    NUMBERED,
    f"d0 AS (SELECT *, x - {lag('x')} AS d FROM src)",
    "d1 AS MATERIALIZED (SELECT code, date, rn, greatest(d, CAST(0 AS DOUBLE)) AS gain, -least(d, CAST(0 AS DOUBLE)) AS loss FROM d0)",
    recur(
        "rr",
        "d1",
        {n: f"s.{x}" for n, x in gains.items()},
        {n: ema_step(f"r.{n}", f"s.{x}", 1 / int(n[1:])) for n, x in gains.items()},
        2,
    ),
)
panel_query(
    "ta_sma",
    {f"SMA_{w}": f"sma{w}" for w in TREND}
    | {f"Price_SMA{w}_Ratio": fill(f"({eps('adj_close', f'sma{w}')} - 1) * 100", 0) for w in TREND},
    "sm",
    "sm AS (SELECT code, date, adj_close, "
    + ", ".join(f"coalesce({roll('avg', w, w, 'adj_close')}, adj_close) AS sma{w}" for w in TREND)
    + " FROM panel)",
)
ORACLE["ta_ema"] = q(
    f"SELECT {sel('s.code, s.date', {f'EMA_{w}': f'e{w}' for w in TREND})} FROM src s JOIN rr ON rr.code = s.code AND rr.rn = s.rn",
    NUMBERED,
    recur("rr", "src", {f"e{w}": "s.x" for w in TREND}, {f"e{w}": ema_step(f"r.e{w}", "s.x", 2 / (w + 1)) for w in TREND}),
)
_fast, _slow = ema_step("r.f", "s.x", 2 / 13), ema_step("r.sl", "s.x", 2 / 27)
ORACLE["ta_macd"] = q(
    f"SELECT {sel('s.code, s.date', {'MACD': 'f - sl', 'MACD_Signal': 'sg', 'MACD_Hist': '(f - sl) - sg'})} "
    "FROM src s JOIN rr ON rr.code = s.code AND rr.rn = s.rn",
    NUMBERED,
    recur(
        "rr",
        "src",
        {"f": "s.x", "sl": "s.x", "sg": "CAST(0 AS DOUBLE)"},
        {"f": _fast, "sl": _slow, "sg": ema_step("r.sg", f"({_fast}) - ({_slow})", 2 / 10)},
    ),
)
_k = ema_step("r.k", "s.rsv", 1 / 3)
ORACLE["ta_kd"] = q(
    f"SELECT {sel('s.code, s.date', {'K': fill('k', 50), 'D': fill('d', 50), 'KD_Diff': fill('k', 50) + ' - ' + fill('d', 50)})} "
    "FROM rs s LEFT JOIN rr ON rr.code = s.code AND rr.rn = s.rn",
    f"r0 AS (SELECT code, date, adj_close, row_number() OVER {E} AS rn, {roll('min', 9, 9, 'low')} AS ll, "
    f"{roll('max', 9, 9, 'high')} AS hh FROM panel)",
    "rs AS MATERIALIZED (SELECT code, date, rn, 100 * (adj_close - ll) / (hh - ll + 1e-9) AS rsv FROM r0)",
    recur(
        "rr",
        "rs",
        {"k": ema_step(num(50), "s.rsv", 1 / 3), "d": ema_step(num(50), ema_step(num(50), "s.rsv", 1 / 3), 1 / 3)},
        {"k": _k, "d": ema_step("r.d", _k, 1 / 3)},
        9,
    ),
)
panel_query(
    "ta_williams_r",
    {
        f"Williams_R_{w}": fill(
            f"-100 * (({roll('max', w, w, 'high')}) - adj_close) / (({roll('max', w, w, 'high')}) - ({roll('min', w, w, 'low')}) + 1e-9)",
            -50,
        )
        for w in (14, 28)
    },
)
panel_query(
    "ta_roc_momentum",
    {f"ROC_{w}": fill(f"100 * (adj_close - {lag('adj_close', w)}) / (({lag('adj_close', w)}) + 1e-9)", 0) for w in (5, 10, 20)}
    | {f"Momentum_{w}": fill(f"adj_close - {lag('adj_close', w)}", 0) for w in (5, 10, 20)},
)
ORACLE["ta_atr"] = q(
    "SELECT "
    + sel(
        "s.code, s.date",
        {f"ATR_{w}": fill(f"a{w}", 0) for w in (14, 28)}
        | {f"ATR_{w}_Pct": fill(f"{eps(f'a{w}', 'adj_close')} * 100", 0) for w in (14, 28)},
    )
    + " FROM tr s JOIN rr ON rr.code = s.code AND rr.rn = s.rn",
    f"pc AS (SELECT code, date, high, low, adj_close, row_number() OVER {E} AS rn, {lag('adj_close')} AS pc FROM panel)",
    "tr AS MATERIALIZED (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM pc)",
    recur("rr", "tr", {f"a{w}": "s.tr" for w in (14, 28)}, {f"a{w}": ema_step(f"r.a{w}", "s.tr", 2 / (w + 1)) for w in (14, 28)}),
)
panel_query(
    "ta_bollinger",
    {
        "BB_Upper_20": fill("m + 2 * s", 0),
        "BB_Middle_20": fill("m", 0),
        "BB_Lower_20": fill("m - 2 * s", 0),
        "BB_PctB_20": fill("(adj_close - (m - 2 * s)) / ((m + 2 * s) - (m - 2 * s) + 1e-9)", 0),
    },
    "bb",
    f"bb AS (SELECT code, date, adj_close, {roll('avg', 20, 20, 'adj_close')} AS m, {roll('stddev_samp', 20, 20, 'adj_close')} AS s FROM panel)",
)
ORACLE["ta_obv"] = q(f"SELECT {sel('code, date', plain(['OBV', 'OBV_ROC']))} FROM ob", *OBV)
panel_query(
    "ta_vwap",
    {"VWAP": "vwap", "Price_VWAP_Ratio": f"({eps('adj_close', 'vwap')} - 1) * 100"},
    "vw",
    f"vw AS (SELECT code, date, adj_close, coalesce((sum((high + low + adj_close) / 3 * volume) OVER {UPTO}) / ((sum(volume) OVER {UPTO}) + 1e-9), 0) AS vwap FROM panel)",
)
panel_query(
    "ta_volume_ratio",
    {f"Volume_SMA_{w}": fill(f"avg(volume) OVER {rows(w)}", 0) for w in (5, 20)}
    | {f"Volume_Ratio_{w}": fill(f"volume / ((avg(volume) OVER {rows(w)}) + 1e-9)", 0) for w in (5, 20)},
)
panel_query(
    "own_steps",
    {
        "range_share": "share",
        "range_trend": f"CASE WHEN count(share) OVER {rows(5)} >= 3 THEN avg(share) OVER {rows(5)} END",
        "volume_step": f"volume - {lag('volume')}",
    },
    "s1",
    "s1 AS (SELECT *, (high - low) / (low + 1) AS share FROM panel)",
)
panel_query(
    "ta_cci",
    {
        f"CCI_{w}": fill(f"CASE WHEN rn >= {w} THEN (tp - m{w}) / (0.015e0 * (list_sum(list_transform(v{w}, lambda x: abs(x - m{w}))) / {w}) + 1e-9) END", 0)
        for w in (14, 20)
    },
    "c2",
    f"c1 AS (SELECT code, date, (high + low + adj_close) / 3 AS tp, row_number() OVER {E} AS rn FROM panel)",
    "c2 AS (SELECT *, "
    + ", ".join(f"avg(tp) OVER {rows(w)} AS m{w}, list(tp) OVER {rows(w)} AS v{w}" for w in (14, 20))
    + " FROM c1)",
)

# --- features --------------------------------------------------------------------------------------------------------

panel_query(
    "price_derived",
    {
        "hl_spread": clip("((high - low) / (close + 1e-9))", 0, 1),
        "float_turnover": fill(clip("(volume / greatest(fii_shares - insider_shares, CAST(1 AS DOUBLE)) * 100)", 0, 100), 0),
        "cash_trade_share": fill(clip("((volume - intraday_shares) / (volume + 1e-9))", 0, 1), 0),
        "intraday_sell_share": fill("intraday_sell_pct", 0),
        "close_chg": fill(f"close - {lag('close')}", 0),
    },
)
panel_query(
    "momentum_ext",
    {"log_return": fill(f"ln(adj_close / nullif({lag('adj_close')}, 0) + 1e-9)", 0)}
    | {f"ret_{w}": fill(clip(f"(adj_close / nullif({lag('adj_close', w)}, 0) - 1)", -0.99, 10), 0) for w in (21, 63, 252)}
    | {"ret_21_pct": fill(clip(f"(adj_close / nullif({lag('adj_close', 21)}, 0) - 1)", -0.99, 10), 0) + " * 100"},
)
panel_query(
    "period_to_date_returns",
    {
        o: fill(f"adj_close / ((first_value(adj_close IGNORE NULLS) OVER {whole(u)}) + 1e-9) - 1", 0)
        for o, u in (("ret_mtd", "month"), ("ret_wtd", "week"), ("ret_ytd", "year"), ("ret_qtd", "quarter"))
    },
)
panel_query(
    "capm_betas",
    {f"capm_beta_{w}": fill(beta_raw(w, least), 1) for w, least in ((21, 10), (189, 60), (252, 90))},
    "dr",
    *MARKET,
)
NET = "(fii_net + dealer_net + trust_net)"
LONG_, SHORT_ = "(greatest(margin_balance, CAST(0 AS DOUBLE)) * close)", "(greatest(ms_balance, CAST(0 AS DOUBLE)) * close)"
panel_query(
    "flow_basic",
    {
        "inst_net_amt_k": fill(f"{NET} * close / 1000", 0),
        "trust_net_amt_m": fill("trust_net * close / 1e6", 0),
        "margin_turnover": fill("margin_buy + margin_sell", 0),
        "margin_buy_amt_k": fill("margin_buy * close", 0),
        "margin_util_f": fill("margin_util", 0),
        "margin_chg_amt_k": fill(f"(margin_balance - {lag('margin_balance')}) * close / 1000", 0),
        "maintenance_ratio": fill(clip(f"(({LONG_} + {SHORT_} * 1.9e0) / ({LONG_} * 0.6e0 + {SHORT_} + 1e-9) * 100)", 0, 500), 130),
        "credit_share": fill(clip("((margin_buy + margin_sell + ms_balance) / (volume + 1e-9))", 0, 1), 0),
        "foreign_investable": fill("fii_investable", 0),
        "insider_shares_k": fill("insider_shares / 1000", 0),
        "inst_buy": fill(clip(NET, 0), 0),
        "inst_sell": fill(clip(f"(-{NET})", 0), 0),
        "pbr_f": fill("pbr", 0),
        "margin_buy_f": fill("margin_buy", 0),
        "foreign_sell": fill(clip("(-fii_net)", 0), 0),
        "trust_share": fill(clip("(abs(trust_net) / (volume + 1e-9))", 0, 1), 0),
    },
)
RUNS = (
    f"n0 AS MATERIALIZED (SELECT code, date, dealer_net, fii_net, row_number() OVER {E} AS rn FROM panel)",
    recur(
        "rr",
        "n0",
        {n: x for n, x in (("dr", "s.dealer_net"), ("ds", "sign(s.dealer_net)"), ("fr", "s.fii_net"), ("fs", "sign(s.fii_net)"))},
        {
            k: v
            for p, x in (("d", "s.dealer_net"), ("f", "s.fii_net"))
            for k, v in (
                (f"{p}r", f"CASE WHEN {x} <> 0 AND r.{p}s <> 0 AND sign({x}) <> r.{p}s THEN {x} ELSE r.{p}r + {x} END"),
                (f"{p}s", f"CASE WHEN {x} <> 0 THEN sign({x}) ELSE r.{p}s END"),
            )
        },
    ),
)
ORACLE["flow_runs"] = q(
    f"SELECT {sel('s.code, s.date', {'dealer_run_k': 'dr / 1000', 'foreign_run_k': 'fr / 1000'})} "
    "FROM n0 s JOIN rr ON rr.code = s.code AND rr.rn = s.rn",
    *RUNS,
)


def ptd(x: str, unit: str) -> str:
    return fill(f"(sum({x}) OVER {to_date_in(unit)}) / 1000", 0)


panel_query(
    "flow_period_to_date",
    {
        "dealer_net_wtd": "dealer_net",
        "dealer_wtd_k": ptd("dealer_net", "week"),
        "dealer_mtd_k": ptd("dealer_net", "month"),
        "dealer_ytd_k": ptd("dealer_net", "year"),
        "foreign_wtd_k": ptd("fii_net", "week"),
        "foreign_ytd_k": ptd("fii_net", "year"),
        "inst_amt_mtd_k": ptd(f"{NET} * close", "month"),
        "inst_amt_wtd_k": ptd(f"{NET} * close", "week"),
        "dealer_amt_wtd_k": ptd("dealer_net * close", "week"),
        "dealer_mtd_k2": ptd("dealer_net", "month"),
    },
)
panel_query("flow_buy_days", {"inst_buy_days_20": f"sum(CASE WHEN {NET} > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) OVER {rows(20)}"})
panel_query(
    "fundamental_basic",
    {
        "rev_ly_cum_k": fill("monthly_revenue_ly_cum / 1000", 0),
        "rev_mom": fill("monthly_revenue_mom", 0),
        "rev_per_share": fill("monthly_revenue / (fii_shares + 1e-9)", 0),
        "eps_f": fill("eps", 0),
    },
)
ORACLE["revenue_growth"] = q(
    "SELECT "
    + sel(
        "code, date",
        {
            o: fill(f"CASE WHEN known >= 63 THEN {clip(f'(r{w} / (abs({lag(f"r{w}", w)}) + 1e-9) - 1)', -2, 10)} END", 0)
            for o, w in (("rev_chg_63", 63), ("rev_chg_252", 252))
        },
    )
    + " FROM v1",
    "v1 AS (SELECT code, date, count(monthly_revenue) OVER (PARTITION BY code) AS known, "
    f"{roll('sum', 63, 31, 'monthly_revenue')} AS r63, {roll('sum', 252, 126, 'monthly_revenue')} AS r252 FROM panel)",
)
panel_query(
    "revenue_hist_low",
    {"rev_vs_hist_low": fill(clip("(monthly_revenue / (abs(lo) + 1e-9) - 1)", 0, 100), 0)},
    "hl",
    f"hl AS (SELECT code, date, monthly_revenue, min(monthly_revenue) OVER {PRIOR} AS lo FROM panel)",
)
panel_query(
    "short_basic",
    {
        "short_sell_volume_ratio": fill(clip("(ms_balance / (volume + 1e-9))", 0, 1), 0),
        "short_headroom": fill(clip("(1 - ms_balance / (ms_limit + 1e-9))", 0, 1), 1),
        "headroom_log": fill("ln(1 + greatest(ms_limit - ms_balance, CAST(0 AS DOUBLE)))", 0),
        "inst_retail_ratio": fill(clip("(sl_sell_balance / (sl_balance + 1e-9))", 0, 1), 0),
        "short_net_flow_sec": fill(f"sl_sell_balance - {lag('sl_sell_balance')}", 0),
    }
    | {f"{x}_log": fill(f"ln(1 + greatest({x}, CAST(0 AS DOUBLE)))", 0) for x in ("sl_sell_balance", "sl_balance", "ms_balance")},
)
ORACLE["short_cover"] = q(
    f"SELECT {sel('code, date', {'days_to_cover': 'dtc', 'days_to_cover_rank': '((rank() OVER (PARTITION BY date ORDER BY dtc)) + ((count(*) OVER (PARTITION BY date, dtc)) - 1) / 2.0) / (count(*) OVER (PARTITION BY date))'})} FROM k2",
    f"k1 AS (SELECT code, date, volume, sl_sell_balance, {roll('avg', 20, 5, 'volume')} AS av FROM panel)",
    f"k2 AS (SELECT code, date, {fill(clip('(sl_sell_balance / (coalesce(av, volume) + 1e-9))', 0, 250), 0)} AS dtc FROM k1)",
)
panel_query(
    "short_chg",
    {f"short_balance_chg_{w}d": fill(clip(f"({ieee('sl_sell_balance', lag('sl_sell_balance', w))} - 1)", -2, 2), 0) for w in (5, 10, 20)},
)
ORACLE["beta_vasicek"] = q(f"SELECT {sel('code, date', plain(['daily_return', 'vol20', 'beta']))} FROM lb", *BETA)
panel_query(
    "excess_features",
    {
        "ret_1d": "r1",
        "excess_1d": "r1 - market_return",
        "excess_wtd": "(adj_close / (fw + 1e-9) - 1) - (gw - 1)",
    },
    "x1",
    *MARKET,
    f"x1 AS (SELECT code, date, adj_close, market_return, {fill(clip(f'(adj_close / nullif({lag("adj_close")}, 0) - 1)', -0.5, 0.5), 0)} AS r1, "
    f"first_value(adj_close IGNORE NULLS) OVER {whole('week')} AS fw, product(1 + market_return) OVER {to_date_in('week')} AS gw FROM mp)",
)
panel_query(
    "valuation",
    {"price_to_sales": fill(clip("(market_value / nullif(monthly_revenue_ly_cum, 0))", 0, 200), 0), "equity_k": fill("equity / 1000", 0)},
)
ORACLE["eps_ttm"] = q(
    "SELECT "
    + sel(
        "code, date",
        {
            "eps_ttm": fill("te", 0),
            "eps_ttm_yoy": fill(clip(f"(te / (abs({lag('te', 252)}) + 1e-9) - 1)", -2, 10), 0),
            "pretax_prev_year": fill(lag("tp", 252), 0),
        },
    )
    + " FROM t3",
    f"t1 AS (SELECT code, date, {lag('eps')} AS e, {lag('pretax_profit')} AS p FROM panel)",
    f"t2 AS (SELECT code, date, last_value(e IGNORE NULLS) OVER {UPTO} AS e, last_value(p IGNORE NULLS) OVER {UPTO} AS p FROM t1)",
    f"t3 AS (SELECT code, date, {roll('sum', 252, 63, 'e')} AS te, {roll('sum', 252, 63, 'p')} AS tp FROM t2)",
)
panel_query("signed_log1p", {"fii_signed_log": "sign(fii_net) * ln(1 + abs(fii_net))"})

# --- labels ----------------------------------------------------------------------------------------------------------

TICKS = ["return_tick", "return_tick_0", "excess_return_tick"]
ORACLE["labels"] = q(
    f"SELECT {sel('code, date', plain(['return', 'excess_return']))}, {', '.join(TICKS)} FROM labelled", *BETA
)
ORACLE["label_positive_rates"] = q(f"SELECT {sel('', {f'{t}_rate': f'avg(CAST({t} AS DOUBLE))' for t in TICKS})} FROM labelled", *BETA)
ORACLE["label_value_counts"] = q(
    f"SELECT label, value, n_rows, {c('n_rows / CAST(sum(n_rows) OVER (PARTITION BY label) AS DOUBLE)')} AS share FROM ("
    + " UNION ALL ".join(
        f"SELECT '{t}' AS label, {t} AS value, count(*) AS n_rows FROM labelled WHERE {t} IS NOT NULL GROUP BY {t}"
        for t in ("return_tick", "excess_return_tick")
    )
    + ")",
    *BETA,
)


def histogram(x: str) -> str:
    e = f"(SELECT min({x}) AS lo, max({x}) AS hi, avg({x}) AS mean, median({x}) AS med FROM labelled)"
    return (
        f"SELECT '{x}' AS label, CAST(b AS INTEGER) AS bin, {c('lo + b * ((hi - lo) / CAST(100 AS DOUBLE))')} AS bin_low, "
        f"(SELECT count(*) FROM labelled WHERE {x} IS NOT NULL AND least(CAST(floor(({x} - lo) / ((hi - lo) / CAST(100 AS DOUBLE))) AS INTEGER), 99) = b) AS n_rows, "
        f"{c('mean')} AS mean, {c('med')} AS median FROM range(100) t(b), {e}"
    )


ORACLE["label_histogram"] = q(f"{histogram('return')} UNION ALL {histogram('excess_return')}", *BETA)
ORACLE["panel_profile"] = q(
    f"SELECT count(*) AS n_rows, count(DISTINCT code) AS n_codes, min(date) AS first_date, max(date) AS last_date, "
    f"{c('avg(beta)')} AS beta_mean, {c('stddev_samp(beta)')} AS beta_std, {c('avg(vol20)')} AS vol20_mean, "
    f"{c('stddev_samp(vol20)')} AS vol20_std, 3 AS n_indicator_columns, 0 AS n_short_columns FROM labelled",
    *BETA,
)

# --- cross-section and back-test -------------------------------------------------------------------------------------

ORACLE["decile_assign"] = q(f"SELECT code, date, {c('y_prob')} AS y_prob, decile FROM ranked", *PRED)
ORACLE["decile_counts"] = q("SELECT decile, count(*) AS n_rows FROM ranked WHERE decile IS NOT NULL GROUP BY decile", *PRED)
ORACLE["decile_daily_returns"] = q(
    f"SELECT {sel('date', {d: f'({d} - {num(5 / 10_000 * 2)}) * {num(0.5)}' for d in DECILES})} FROM series", *SERIES
)
ORACLE["benchmark_align"] = q(
    f"SELECT {sel('date', plain(['D1', 'market', 'excess_D1']))}, market IS NULL AS no_benchmark FROM series", *SERIES
)
ORACLE["performance_metrics"] = q(
    f"SELECT {sel('series', plain(['ann_return', 'ann_std', 'sharpe', 'mdd', 'calmar', 'hit_rate']))}, n_days FROM perf", *METRICS
)
ORACLE["alpha_ir"] = q(
    f"SELECT series, n_common, {c('CASE WHEN n_common > 10 THEN (pow(g, 252e0 / n) - 1) - (pow(gm, 252e0 / n_common) - 1) END')} AS alpha, "
    f"{c('CASE WHEN n_common > 10 AND sd > 0 THEN mu * 252 / (sd * sqrt(252e0)) END')} AS ir FROM ai",
    *SERIES,
    "ai AS (SELECT l.series, count(m.ret) AS n_common, count(l.ret) AS n, product(1 + l.ret) AS g, product(1 + m.ret) AS gm, "
    "avg(l.ret - m.ret) AS mu, stddev_samp(l.ret - m.ret) AS sd FROM long l LEFT JOIN (SELECT date, ret FROM long "
    "WHERE series = 'market' AND ret IS NOT NULL) m ON m.date = l.date WHERE l.series NOT IN ('market', 'excess_D1') "
    "AND l.ret IS NOT NULL GROUP BY l.series)",
)
ORACLE["annual_returns"] = q(
    f"SELECT a.year, {c('a.r')} AS strategy, {c('b.r')} AS market FROM "
    "(SELECT CAST(year(date) AS INTEGER) AS year, product(1 + D1) - 1 AS r FROM series WHERE D1 IS NOT NULL GROUP BY 1) a JOIN "
    "(SELECT CAST(year(date) AS INTEGER) AS year, product(1 + market) - 1 AS r FROM series WHERE market IS NOT NULL GROUP BY 1) b "
    "ON a.year = b.year",
    *SERIES,
)
ORACLE["cumulative_nav"] = q(
    f"SELECT {sel('series, date', {'nav': 'nav', 'log10_nav': 'CASE WHEN nav > 0 THEN log10(nav) END'})} FROM cn",
    *SERIES,
    f"cn AS (SELECT series, date, product(1 + coalesce(ret, 0)) OVER {SERIES_UPTO} AS nav FROM long)",
)
ORACLE["decile_summary"] = q(
    f"SELECT {sel('series', {'ln_ann_return': 'ln(1 + greatest(ann_return, -0.999e0))', 'sharpe': 'sharpe'})} FROM perf WHERE series <> 'excess_D1'",
    *METRICS,
)
ORACLE["relative_nav"] = q(f"SELECT {sel('date', plain(['rel', 'dd']))} FROM rel", *REL)
ORACLE["drawdown_curve"] = q(
    f"SELECT date, {c(f'(nav - (max(nav) OVER {DAYS_UPTO})) / (max(nav) OVER {DAYS_UPTO})')} AS dd FROM uw",
    *SERIES,
    f"uw AS (SELECT date, product(1 + coalesce(s, 0)) OVER {DAYS_UPTO} AS nav FROM pair)",
)
ORACLE["drawdown_episodes"] = q(
    f"SELECT peak, trough, recovery, {c('depth')} AS depth, days_to_trough, days_underwater, ongoing FROM episodes", *REL
)
ORACLE["drawdown_topk"] = q(
    f"SELECT CAST(rk AS INTEGER) AS rank, peak, trough, recovery, {c('depth')} AS depth, days_underwater, lg = 1 AS longest FROM "
    "(SELECT *, row_number() OVER (ORDER BY depth, peak) AS rk, row_number() OVER (ORDER BY days_underwater DESC, depth, peak) AS lg "
    "FROM episodes) WHERE rk <= 5 OR lg = 1",
    *REL,
)


def strategy_beta(frame: str) -> tuple[str, ...]:
    return (
        f"sb1 AS (SELECT date, count(*) OVER {frame} AS n, covar_samp(s, m) OVER {frame} AS cv, var_samp(m) OVER {frame} AS vr FROM pair "
        "WHERE s IS NOT NULL AND m IS NOT NULL)",
        "sb2 AS (SELECT date, lag(CASE WHEN n >= 60 AND vr <> 0 THEN cv / vr END) OVER (ORDER BY date) AS b FROM sb1)",
        "sbeta AS (SELECT p.date, p.s, p.m, coalesce(first_value(b IGNORE NULLS) OVER (ORDER BY p.date ROWS BETWEEN CURRENT ROW AND "
        "UNBOUNDED FOLLOWING), 1) AS beta FROM pair p LEFT JOIN sb2 ON sb2.date = p.date)",
    )


ROLL_252 = "(ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
ORACLE["strategy_beta_rolling"] = q(f"SELECT date, {c('beta')} AS beta FROM sbeta", *SERIES, *strategy_beta(ROLL_252))
ORACLE["strategy_beta_expanding"] = q(f"SELECT date, {c('beta')} AS beta FROM sbeta", *SERIES, *strategy_beta(DAYS_UPTO))
ORACLE["strategy_beta_full"] = q(
    f"SELECT date, {c('(SELECT covar_samp(s, m) / var_samp(m) FROM pair WHERE s IS NOT NULL AND m IS NOT NULL)')} AS beta FROM pair",
    *SERIES,
)
ORACLE["beta_neutral_excess"] = q(
    f"SELECT date, {c('beta')} AS beta, {c('s - beta * m')} AS excess FROM sbeta", *SERIES, *strategy_beta(ROLL_252)
)

# --- evaluation ------------------------------------------------------------------------------------------------------

ORACLE["classifier_metrics"] = q(
    "SELECT "
    + sel(
        'cm."window"',
        {
            "log_loss": "CASE WHEN p > 0 AND n > p THEN ll END",
            "roc_auc": "CASE WHEN p > 0 AND n > p THEN u / (CAST(p AS DOUBLE) * (n - p)) END",
            "accuracy": "(tp + tn) / n",
            "precision": "coalesce(tp / nullif(tp + fp, 0), 0)",
            "recall": "coalesce(tp / nullif(tp + fn, 0), 0)",
            "f1": "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)",
            "positive_rate_true": "p / n",
            "positive_rate_pred": "(tp + fp) / n",
        },
    )
    + ', CAST(n AS BIGINT) AS n_test FROM cm JOIN au ON au."window" = cm."window"',
    *PRED,
    "ev AS MATERIALIZED (SELECT * FROM predictions WHERE y_true IS NOT NULL)",
    'cm AS (SELECT "window", CAST(count(*) AS DOUBLE) AS n, CAST(sum(y_true) AS DOUBLE) AS p, '
    + ", ".join(
        f"CAST(count(*) FILTER (y_true = {a} AND y_pred = {b}) AS DOUBLE) AS {n}"
        for n, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))
    )
    + ", avg(-CASE WHEN y_true = 1 THEN ln(greatest(least(y_prob, 1 - 1e-7), 1e-7)) ELSE ln(1 - greatest(least(y_prob, 1 - 1e-7), 1e-7)) END) AS ll "
    'FROM ev GROUP BY "window")',
    'ar AS (SELECT *, (rank() OVER (PARTITION BY "window" ORDER BY y_prob)) + ((count(*) OVER (PARTITION BY "window", y_prob)) - 1) / 2e0 AS rk FROM ev)',
    'au AS (SELECT "window", sum(rk) FILTER (y_true = 1) - CAST(sum(y_true) AS DOUBLE) * (sum(y_true) + 1) / 2 AS u FROM ar GROUP BY "window")',
)
ORACLE["f1_threshold"] = q(
    f'SELECT "window", CASE WHEN max(f1) > 0 THEN arg_max(t, (f1, -t)) ELSE 0.5e0 END AS threshold, {c("max(f1)")} AS f1 '
    'FROM sw GROUP BY "window"',
    *PRED,
    "ev AS MATERIALIZED (SELECT * FROM predictions WHERE y_true IS NOT NULL)",
    'dy AS (SELECT "window", min(date) AS lo, max(date) AS hi FROM ev GROUP BY "window")',
    'oof AS MATERIALIZED (SELECT ev."window", y_true, y_prob FROM ev JOIN dy ON dy."window" = ev."window" '
    "WHERE date_diff('day', lo, date) * 4 >= date_diff('day', lo, hi))",
    "th AS (SELECT i, 0.05e0 + 0.01e0 * i AS t FROM range(65) r(i))",
    'sw AS (SELECT "window", round(t, 2) AS t, coalesce(2e0 * sum(CASE WHEN y_true = 1 AND y_prob >= t THEN 1 ELSE 0 END) / nullif('
    "sum(CASE WHEN y_prob >= t THEN 1 ELSE 0 END) + sum(y_true), 0), 0) AS f1 FROM oof, th GROUP BY 1, 2)",
)
TRAIN = (
    *BETA,
    PLAN,
    'tr AS MATERIALIZED (SELECT "window", code, date, round(vol20, 9) AS vol20 FROM labelled JOIN wins '
    "ON year(date) = y AND role = 'train' WHERE excess_return_tick IS NOT NULL)",
)
ORACLE["vol_rank_weights"] = q(
    f"SELECT {sel(chr(34) + 'window' + chr(34) + ', code, date', {'vol20': 'vol20', 'weight': 'rk / (avg(rk) OVER (PARTITION BY ' + chr(34) + 'window' + chr(34) + '))'})} FROM v2",
    *TRAIN,
    'v1 AS (SELECT *, coalesce(vol20, median(vol20) OVER (PARTITION BY "window")) AS v FROM tr)',
    'v2 AS (SELECT *, (rank() OVER (PARTITION BY "window" ORDER BY v DESC)) + ((count(*) OVER (PARTITION BY "window", v)) - 1) / 2e0 AS rk FROM v1)',
)
ORACLE["cv_folds"] = q(
    'SELECT "window", date, CAST(k AS INTEGER) AS date_no, CASE WHEN k > n - 3 * (n // 4) AND n > 3 THEN '
    "CAST((k - 1 - (n - 3 * (n // 4))) // (n // 4) + 1 AS INTEGER) END AS fold, CAST(n // 4 AS INTEGER) AS test_size FROM f2",
    *TRAIN,
    'f1 AS (SELECT DISTINCT "window", date FROM tr)',
    'f2 AS (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY date) AS k, count(*) OVER (PARTITION BY "window") AS n FROM f1)',
)

ORACLE["oof_pattern"] = q(
    "SELECT r.code, r.date, CASE WHEN k > n - 3 * (n // 4) AND n > 3 THEN CAST((k - 1 - (n - 3 * (n // 4))) // (n // 4) + 1 AS INTEGER) END AS fold, "
    "excess_return_tick AS y_true, k > n - 3 * (n // 4) AS has_prob, CASE WHEN k > n - 3 * (n // 4) THEN true END AS is_prob "
    "FROM (SELECT * FROM labelled WHERE excess_return_tick IS NOT NULL) r JOIN f2 ON f2.date = r.date",
    *BETA,
    "f1 AS (SELECT DISTINCT date FROM labelled WHERE excess_return_tick IS NOT NULL)",
    "f2 AS (SELECT date, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS n FROM f1)",
)
TESTED = f"year(date) BETWEEN {FIRST_YEAR + 2} AND {LAST_YEAR} AND excess_return_tick IS NOT NULL"
ORACLE["walk_forward_rows"] = q(
    "SELECT code, date, CAST(year(date) - 2 AS VARCHAR) || '_' || CAST(year(date) AS VARCHAR) AS \"window\", "
    f"{c('return')} AS return, excess_return_tick AS y_true, true AS is_prob FROM labelled WHERE {TESTED}",
    *BETA,
)
ORACLE["walk_forward_metrics"] = q(
    "SELECT CAST(year(date) - 2 AS VARCHAR) || '_' || CAST(year(date) AS VARCHAR) AS \"window\", CAST(year(date) AS INTEGER) AS test_year, "
    f"count(*) AS n_test, true AS agrees, year(date) = {FIRST_YEAR + 2} AS tuned FROM labelled WHERE {TESTED} GROUP BY year(date)",
    *BETA,
)


def aged_step(v: str, w: str, x: str, a: float) -> tuple[str, str]:
    """Mean and weight of the old mean after value x (which may be missing)."""
    old = f"({w} * {num(1 - a)})"
    mean = f"CASE WHEN {x} IS NULL THEN {v} WHEN {v} IS NULL THEN {x} ELSE ({old} * {v} + {num(a)} * {x}) / ({old} + {num(a)}) END"
    return mean, f"CASE WHEN {x} IS NULL THEN {old} ELSE {num(1)} END"


_e5, _w5 = aged_step("r.e5", "r.w5", "s.x", 2 / 6)
_e60, _w60 = aged_step("r.e60", "r.w60", "s.x", 2 / 61)
_kg = f"CASE WHEN s.rsv IS NULL THEN r.k ELSE {ema_step('r.k', 's.rsv', 1 / 3)} END"
_k1 = f"CASE WHEN s.rsv IS NULL THEN {num(50)} ELSE {ema_step(num(50), 's.rsv', 1 / 3)} END"
ORACLE["ta_gaps"] = q(
    f"SELECT {sel('s.code, s.date', {'EMA_5': 'coalesce(e5, x)', 'EMA_60': 'coalesce(e60, x)', 'K': 'CASE WHEN s.rsv IS NULL THEN 50 ELSE k END', 'D': 'CASE WHEN s.rsv IS NULL THEN 50 ELSE d END'})} "
    "FROM sg s JOIN rr ON rr.code = s.code AND rr.rn = s.rn",
    "gp AS (SELECT code, date, high, low, CASE WHEN CAST(volume AS BIGINT) % 5 = 0 THEN NULL ELSE adj_close END AS x FROM panel)",
    f"gr AS (SELECT *, row_number() OVER {E} AS rn, {roll('min', 9, 9, 'low')} AS ll, {roll('max', 9, 9, 'high')} AS hh FROM gp)",
    "sg AS MATERIALIZED (SELECT code, date, rn, x, 100 * (x - ll) / (hh - ll + 1e-9) AS rsv FROM gr)",
    recur(
        "rr",
        "sg",
        {"e5": "s.x", "w5": num(1), "e60": "s.x", "w60": num(1), "k": _k1, "d": f"CASE WHEN s.rsv IS NULL THEN {num(50)} ELSE {ema_step(num(50), _k1, 1 / 3)} END"},
        {"e5": _e5, "w5": _w5, "e60": _e60, "w60": _w60, "k": _kg, "d": f"CASE WHEN s.rsv IS NULL THEN r.d ELSE {ema_step('r.d', '(' + _kg + ')', 1 / 3)} END"},
    ),
)
_zr = {f"ret_{w}": fill(clip(f"({ieee('x', lag('x', w))} - 1)", -0.99, 10), 0) for w in (21, 63, 252)}
ORACLE["returns_of_zero_prices"] = q(
    f"SELECT {sel('code, date', _zr | {'ret_1d': fill(clip('(g - 1)', -0.5, 0.5), 0), 'vol20': fill(roll('stddev_samp', 20, 10, 'dr') + ' * sqrt(' + num(252) + ')', 0)})}, "
    "CASE WHEN isinf(coalesce(g, 0)) THEN 1 ELSE 0 END AS log_infinite, CASE WHEN isinf(coalesce(g, 0)) THEN 1 ELSE 0 END AS daily_infinite FROM z2",
    "z1 AS (SELECT code, date, CASE WHEN CAST(volume AS BIGINT) % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE adj_close END AS x FROM panel)",
    f"z2 AS (SELECT *, {ieee('x', lag('x'))} AS g, CASE WHEN NOT isinf(coalesce({ieee('x', lag('x'))}, 1)) THEN coalesce({ieee('x', lag('x'))} - 1, 0) END AS dr FROM z1)",
)

# The feature queries side by side, key by key.
ORACLE["feature_table"] = (
    "SELECT code, date, "
    + ", ".join(x for cols in STEP_COLUMNS.values() for x in cols)
    + " FROM "
    + " JOIN ".join(
        f"({ORACLE[n]}) t{i}" + ("" if i == 0 else " USING (code, date)") for i, n in enumerate(STEP_COLUMNS)
    )
)
