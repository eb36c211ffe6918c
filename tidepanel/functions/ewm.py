"""Exponentially weighted means (recursive form) as window sums.

Unseeded means follow the rule of data frames: the first value starts the mean; a missing value carries the mean on and ages it, so that
the next value x after m rows gives (d y + a x) / (d + a) with d = (1 - a)^m. Seeded means follow a loop that starts from
the seed and passes over missing values: those neither age the mean nor have one.

Both are y = y_before exp(-step) + gain x, a running sum of gain x exp(L) scaled by exp(-L), where L is the running sum of the
steps. Rows are cut into blocks so that the scaling does not overflow. What comes before a block enters exactly, as the sum over the ends of all
earlier blocks; a code has a handful of them. All means share blocks, sorts and windows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.num import lit
from tidepanel.functions.windows import CODE, DATE, before, entity, lead, run_stages, so_far

# Decades by which the fastest mean of a run may age inside a block.
MOST_DECADES = 240


@dataclass(frozen=True)
class Ewm:
    """out = EWM of column x with weight alpha; seed is the value before the first observation."""

    out: str
    x: str
    alpha: float
    seed: float | None = None


def span(w: int) -> float:
    return 2.0 / (w + 1)


def ewm(df: DataFrame, specs: list[Ewm]) -> DataFrame:
    """Add one column per spec."""
    inputs = sorted({s.x for s in specs})
    # Means of one input, weight and rule age alike.
    kinds = list(dict.fromkeys((s.x, s.alpha, s.seed is None) for s in specs))
    kept = df.columns
    df = df.withColumns({"__row": F.row_number().over(entity())} | {f"__seen_{x}": F.count(x).over(so_far()) for x in inputs})
    df = df.withColumns({f"__at_{x}": F.max(F.when(F.col(x).isNotNull(), F.col("__row"))).over(before()) for x in inputs})
    step, gain = {}, {}
    for k, (x, alpha, aged) in enumerate(kinds):
        m = (F.col("__row") - F.col(f"__at_{x}")) if aged else F.lit(1)
        excess = F.pow(lit(1 - alpha), m) - lit(1 - alpha)  # 0 without a gap
        later = F.col(x).isNotNull() & (F.col(f"__seen_{x}") > 1)
        step[f"__step_{k}"] = F.when(later, lit(-math.log(1 - alpha)) * m + F.log1p(excess)).otherwise(lit(0))
        gain[k] = F.when(F.col(f"__seen_{x}") > 1, lit(alpha) / (lit(1) + excess)).otherwise(lit(1))
    df = df.withColumns(step)
    fastest = F.greatest(*step) if len(step) > 1 else F.col("__step_0")
    block = F.floor(F.sum(fastest).over(so_far()) / lit(MOST_DECADES * math.log(10)))
    df = df.withColumns({f"__age_{k}": F.sum(f"__step_{k}").over(so_far()) for k in range(len(kinds))} | {"__blk": block})
    df = df.withColumn("__end", F.coalesce(lead(F.col("__blk")) != F.col("__blk"), F.lit(False)))
    to_row = Window.partitionBy(CODE, "__blk").orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    # Same sort order, so both window kinds share one sort.
    prior = Window.partitionBy(CODE).orderBy("__blk", DATE).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({f"__zero_{k}": F.first(f"__age_{k}").over(to_row) for k in range(len(kinds))})
    local = {}
    for i, s in enumerate(specs):
        k, x = kinds.index((s.x, s.alpha, s.seed is None)), F.col(s.x)
        first = x if s.seed is None else lit(s.alpha) * x + lit((1 - s.alpha) * s.seed)
        term = F.when(F.col(f"__seen_{s.x}") == 1, first).otherwise(gain[k] * x)
        young = F.col(f"__age_{k}") - F.col(f"__zero_{k}")
        local[f"__sum_{i}"] = F.exp(-young) * F.sum(F.when(x.isNotNull(), term) * F.exp(young)).over(to_row)
    df = df.withColumns(local)
    ends = F.struct(*[F.col(f"__age_{k}") for k in range(len(kinds))], *[F.coalesce(c, lit(0)).alias(c) for c in local])
    df = df.withColumn("__ends", F.collect_list(F.when(F.col("__end"), ends)).over(prior))
    out = {}

    def carried(i: int, k: int) -> Column:
        return F.aggregate("__ends", lit(0), lambda acc, e: acc + e[f"__sum_{i}"] * F.exp(e[f"__age_{k}"] - F.col(f"__age_{k}")))

    for i, s in enumerate(specs):
        k = kinds.index((s.x, s.alpha, s.seed is None))
        carry = carried(i, k)
        has = (F.col(f"__seen_{s.x}") > 0) if s.seed is None else F.col(s.x).isNotNull()
        value = F.coalesce(F.col(f"__sum_{i}"), lit(0)) + F.when(F.size("__ends") > 0, carry).otherwise(lit(0))
        out[s.out] = F.when(has, value)
    return df.withColumns(out).select(*kept, *[c for c in out if c not in kept])


@dataclass(frozen=True)
class Smoothing:
    """An indicator built on means: helper columns, means over them, means over those, outputs."""

    before: dict[str, Column]
    first: list[Ewm]
    between: dict[str, Column]
    second: list[Ewm]
    after: list[dict[str, Column]]


def smooth(df: DataFrame, *parts: Smoothing) -> DataFrame:
    """Run several indicators together, so that they share windows and sorts."""
    kept = set(df.columns)
    df = df.withColumns({o: x for p in parts for o, x in p.before.items()})
    df = ewm(df, [e for p in parts for e in p.first])
    df = df.withColumns({o: x for p in parts for o, x in p.between.items()})
    second = [e for p in parts for e in p.second]
    if second:
        df = ewm(df, second)
    df = run_stages(df, *[p.after for p in parts])
    return df.drop(*[c for c in df.columns if c.startswith("__") and c not in kept])
