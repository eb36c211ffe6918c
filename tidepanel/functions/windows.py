"""Per-entity and per-period window helpers.

An entity has at most one row per calendar day (key de-duplication runs first),
so a per-entity window is bounded by the number of days, whatever the table size.
Per-date groups have no such bound: see ordered.py for those.
"""

from __future__ import annotations

import functools
import operator
import urllib.parse
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidepanel.functions.num import finite, lit

CODE, DATE = "code", "date"


# Bytes of input files aimed at per task of a per-code exchange: columnar files hold rows in a fraction of what a sort needs.
TASK_BYTES = 16 << 20


def exchange_parts(df: DataFrame, task_bytes: int | None = None) -> int:
    """Partitions of an exchange of df: the session's number, or the next multiple of it when the files that df reads hold more than task_bytes for each.

    A number that stays while the table grows makes the sorts of a task outgrow its memory, and then they spill. A multiple,
    since the tasks of a last wave that is nearly empty would leave the other cores idle for as long as a full one takes.
    """
    task_bytes = TASK_BYTES if task_bytes is None else task_bytes
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = [urllib.parse.unquote(f) for f in df.inputFiles()]
    if not files:
        return parts
    # Only the lengths are read. Many files are listed by folder.
    paths = files if len(files) <= 16 else sorted({f.rpartition("/")[0] for f in files})
    size = spark.read.format("binaryFile").load(paths).agg(F.sum("length").alias("n")).first()["n"] or 0
    return parts * max(1, -(-size // (task_bytes * parts)))


def by_code(df: DataFrame) -> DataFrame:
    """Hash rows on the entity once; every per-entity window below reuses this exchange.

    The partition count is the session's, or follows the input where that is too few: window chains turn few input
    bytes into much work, so merging partitions by their input size would leave cores idle.
    """
    return df.repartition(exchange_parts(df), CODE)


def _once(make: Callable[..., WindowSpec]) -> Callable[..., WindowSpec]:
    """A window is made in the JVM with a dozen calls, and the features ask for the same few over a thousand times: once per gateway is enough."""
    made: dict[tuple, WindowSpec] = {}

    @functools.wraps(make)
    def run(*args) -> WindowSpec:
        gateway = SparkContext._gateway
        if gateway is None:
            return make(*args)
        slot = (gateway, *args)
        if slot not in made:
            made[slot] = make(*args)
        return made[slot]

    return run


@_once
def entity() -> WindowSpec:
    return Window.partitionBy(CODE).orderBy(DATE)


@_once
def so_far() -> WindowSpec:
    return entity().rowsBetween(Window.unboundedPreceding, 0)


@_once
def before() -> WindowSpec:
    return entity().rowsBetween(Window.unboundedPreceding, -1)


@_once
def last_rows(w: int) -> WindowSpec:
    return entity().rowsBetween(-(w - 1), 0)


def lag(x: Column, k: int = 1) -> Column:
    return F.lag(x, k).over(entity())


def lead(x: Column, k: int = 1) -> Column:
    return F.lead(x, k).over(entity())


def diff(x: Column) -> Column:
    return x - lag(x)


def roll(agg: Callable[..., Column], w: int, min_rows: int, *cols: Column) -> Column:
    """agg over the last w rows, NULL below min_rows rows where every input is present."""
    present = cols[0].isNotNull()
    for c in cols[1:]:
        present = present & c.isNotNull()
    seen = F.count(F.when(present, 1)).over(last_rows(w))
    return F.when(seen >= min_rows, agg(*cols).over(last_rows(w)))


def ffill(x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(so_far())


def period(unit: str) -> Column:
    """First day of the week (Monday) / month / quarter / year of the row."""
    return F.trunc(DATE, unit)


@_once
def to_date_in(unit: str) -> WindowSpec:
    """Rows of the same entity and period, up to the current one."""
    return (
        Window.partitionBy(F.col(CODE), period(unit))
        .orderBy(DATE)
        .rowsBetween(Window.unboundedPreceding, 0)
    )


def first_in(x: Column, unit: str) -> Column:
    """First non-null value of the period; it may lie after the current row only while all before are null."""
    whole = (
        Window.partitionBy(F.col(CODE), period(unit))
        .orderBy(DATE)
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return F.first(x, ignorenulls=True).over(whole)


def cumsum_in(x: Column, unit: str) -> Column:
    """Running sum inside the period; a null row stays null and does not reset it."""
    return F.when(x.isNotNull(), F.sum(x).over(to_date_in(unit)))


# Columns to add, level by level: an expression may use columns of earlier levels.
Stages = list[dict[str, Column]]


def run_stages(df: DataFrame, *parts: Stages) -> DataFrame:
    """Apply several features together: equal levels go into one projection, so window expressions
    over the same rows share one window operator and one sort. Helper columns (`__`) are dropped."""
    made: list[str] = []
    for level in range(max(map(len, parts), default=0)):
        cols = {o: x for p in parts if level < len(p) for o, x in p[level].items()}
        df, made = df.withColumns(cols), [*made, *cols]
    return df.drop(*[c for c in made if c.startswith("__")])


def feature(fn: Callable[..., Stages]) -> Callable[..., DataFrame]:
    """A stage-list function of the present columns, as DataFrame -> DataFrame; `.stages` keeps the original."""

    @functools.wraps(fn)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        return run_stages(df, fn(set(df.columns), *args, **kwargs))

    run.stages = fn
    return run


# Rows in a short and in a middle piece of a long frame; a frame is put together from pieces that do not overlap.
SHORT, MIDDLE = 12, 60


def moments(tag: str, pairs: dict[str, Column], lengths: list[int]) -> Stages:
    """Rolling sums and counts for long frames at a bounded cost per row.

    For each name -> expression gives `__<tag>_n_<name>_<w>` and `__<tag>_s_<name>_<w>`: count and sum of the
    non-null values among the last w rows. Sums are added up from pieces (sums of 12 rows, of 60 rows made of those, and the rest), each
    taken from an earlier row, so nothing is subtracted: a large value leaves no trace once it has left the frame, as it would in
    differences of running sums. Counts are such differences, which are exact. A sliding frame would cost w additions a row.
    """

    def name_of(size: int, name: str) -> str:
        return f"__{tag}_p{size}_{name}"

    def back(size: int, name: str, rows: int) -> Column:
        c = F.col(name_of(size, name))
        return F.lag(c, rows, 0.0).over(entity()) if rows else c

    short, middle, out = {}, {}, {}
    for name, x in pairs.items():
        x = finite(x)
        short[f"__{tag}_cn_{name}"] = F.count(x).over(so_far())
        n = F.col(f"__{tag}_cn_{name}")
        for w in lengths:
            pieces, done = [], 0
            for size in (MIDDLE, SHORT, w % SHORT):
                while size and done + size <= w:
                    pieces.append(back(size, name, done))
                    done += size
                    if size == MIDDLE:
                        middle[name_of(MIDDLE, name)] = functools.reduce(operator.add, [back(SHORT, name, k) for k in range(0, MIDDLE, SHORT)])
                    if size != w % SHORT:
                        short[name_of(SHORT, name)] = F.coalesce(F.sum(x.cast("double")).over(last_rows(SHORT)), lit(0))
                    else:
                        short[name_of(size, name)] = F.coalesce(F.sum(x.cast("double")).over(last_rows(size)), lit(0))
            out[f"__{tag}_s_{name}_{w}"] = functools.reduce(operator.add, pieces)
            out[f"__{tag}_n_{name}_{w}"] = n - F.coalesce(F.lag(n, w).over(entity()), F.lit(0))
    return [short, middle, out] if middle else [short, out]


def rolling_beta(tag: str, y: str, x: str, specs: dict[str, tuple[int, int]]) -> Stages:
    """cov(y, x) / (var(x) + 1e-9) over several long frames; specs: output -> (rows, least rows)."""
    yy, xx = finite(F.col(y)), finite(F.col(x))
    both = yy.isNotNull() & xx.isNotNull()
    pairs = {"y": F.when(both, yy), "x": F.when(both, xx), "yx": yy * xx, "v": xx, "vv": xx * xx}
    sums = moments(tag, pairs, sorted({w for w, _ in specs.values()}))
    out = {}
    for name, (w, least) in specs.items():
        least = max(least, 2)
        n, nv = F.col(f"__{tag}_n_yx_{w}"), F.col(f"__{tag}_n_v_{w}")
        s = {k: F.col(f"__{tag}_s_{k}_{w}") for k in pairs}
        cov = F.when(n >= least, (s["yx"] - s["y"] * s["x"] / F.greatest(n, F.lit(1))) / F.greatest(n - 1, F.lit(1)))
        var = F.when(nv >= least, (s["vv"] - s["v"] * s["v"] / F.greatest(nv, F.lit(1))) / F.greatest(nv - 1, F.lit(1)))
        out[name] = cov / (F.greatest(var, lit(0)) + lit(1e-9))
    return [*sums, out]


def rolling_variance(tag: str, x: str, specs: dict[str, tuple[int, int]]) -> Stages:
    """Sample variance of x, whose values must be near enough to 0 for their squares, over several long frames; specs: output -> (rows, least rows)."""
    sums = moments(tag, {"x": F.col(x), "xx": F.col(x) * F.col(x)}, sorted({w for w, _ in specs.values()}))
    out = {}
    for name, (w, least) in specs.items():
        n, s, ss = F.col(f"__{tag}_n_x_{w}"), F.col(f"__{tag}_s_x_{w}"), F.col(f"__{tag}_s_xx_{w}")
        out[name] = F.when(n >= max(least, 2), F.greatest((ss - s * s / n) / (n - 1), lit(0)))
    return [*sums, out]


def run_sums(specs: dict[str, str]) -> Stages:
    """Running sum that restarts when the sign turns; zero continues the run, null stays null.

    The sign in force is the last non-zero sign; rows between two turns form an island.
    """
    sign, turn, island, out = {}, {}, {}, {}
    for o, x in specs.items():
        v = F.col(x)
        sign[f"__sign_{o}"] = F.last(F.when(v != 0, F.signum(v)), ignorenulls=True).over(so_far())
        s = F.col(f"__sign_{o}")
        turn[f"__turn_{o}"] = F.when(s != lag(s), 1).otherwise(0)
        island[f"__isl_{o}"] = F.sum(f"__turn_{o}").over(so_far())
        run = Window.partitionBy(CODE, f"__isl_{o}").orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
        out[o] = F.when(v.isNotNull(), F.sum(v).over(run))
    return [sign, turn, island, out]


def drop_private(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__")])
