"""Running sums and ranks inside groups of any size.

A plain window keeps a whole group in one task. That is right while the largest group is small,
and it is checked: the size of the largest group is measured first. Above the bound the rows are range-partitioned on
(group, order), so a hot group is spread over many tasks; per-partition totals give each part its offset.
Both ways give the same values.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.sources.scratch import save

# Largest group a single window task may hold; callers pass narrow rows.
TASK_ROWS = 1_000_000
# Rows aimed at per range partition.
RANGE_ROWS = 1_000_000


def group_sizes(df: DataFrame, group: list[str]) -> tuple[int, int]:
    """(rows of the largest group, rows in all); one column-pruned aggregate."""
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.max("n").alias("largest"), F.sum("n").alias("total")).first()
    return int(row["largest"] or 0), int(row["total"] or 0)


def _spread(df: DataFrame, group: list[str], order: list[Column], parts: int) -> DataFrame:
    """Range-partition and write out, so that the partition number of a row is fixed for good."""
    spread = df.repartitionByRange(parts, *[F.col(g) for g in group], *order)
    return save(spread.withColumn("__part", F.spark_partition_id()), "spread")


def ordered_running_sum(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    sums: dict[str, Column],
    totals: dict[str, str] | None = None,
    task_rows: int | None = None,
) -> DataFrame:
    """Inclusive running sums of `sums` inside `group` along `order`; order must be unique in a group.

    totals: output name -> running-sum name whose group total is wanted as well.
    """
    task_rows = TASK_ROWS if task_rows is None else task_rows
    totals = totals or {}
    largest, total = group_sizes(df, group)
    if largest <= task_rows:
        key = [F.col(g) for g in group] or [F.lit(1)]
        running = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*key)
        out = {o: F.sum(x).over(running) for o, x in sums.items()}
        out |= {t: F.sum(sums[o]).over(whole) for t, o in totals.items()}
        return df.withColumns(out)

    parts = max(2, -(-total // RANGE_ROWS))
    df = _spread(df.withColumns({f"__w_{o}": x for o, x in sums.items()}), group, order, parts)
    per_part = df.groupBy(*group, "__part").agg(*[F.sum(f"__w_{o}").alias(f"__t_{o}") for o in sums])
    key = [F.col(g) for g in group] or [F.lit(1)]
    earlier = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        *[F.col(g).alias(f"__k_{g}") for g in group],
        F.col("__part").alias("__k_part"),
        *[F.coalesce(F.sum(f"__t_{o}").over(earlier), F.lit(0)).alias(f"__o_{o}") for o in sums],
        *[F.sum(f"__t_{o}").over(Window.partitionBy(*key)).alias(t) for t, o in totals.items()],
    )
    on = F.col("__part") == F.col("__k_part")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__k_{g}"))
    local = Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"__l_{o}": F.sum(f"__w_{o}").over(local) for o in sums})
    df = df.join(offsets, on)
    df = df.withColumns({o: F.col(f"__l_{o}") + F.col(f"__o_{o}") for o in sums})
    mine = [f"__{k}_{o}" for k in "wlo" for o in sums] + [f"__k_{g}" for g in group]
    return df.drop("__part", "__k_part", *mine)


def _between(lo: Column, hi: Column, frac: Column) -> Column:
    """Linear interpolation; equal ends are the result, infinite ones too."""
    return F.when(lo == hi, lo).otherwise(lo + (hi - lo) * frac)


def _by_value(df: DataFrame, group: list[str], value: str, p: float, out: str, task_rows: int) -> DataFrame:
    """Quantile per group from counts per distinct value. `__below` rows of a group, if the column is there, are smaller than
    those given, and `__size` is the group's size."""
    part = "__below" in df.columns
    carried = [F.max(c).alias(c) for c in ("__below", "__size") if part]
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("__c"), *carried)
    run = ordered_running_sum(counts, group, [F.col(value)], {"__upto": F.col("__c")}, {"__n": "__upto"}, task_rows)
    if part:
        run = run.withColumns({"__upto": F.col("__upto") + F.col("__below"), "__n": F.col("__size")})
    at = F.lit(p) * (F.col("__n") - 1)
    low, high = F.floor(at), F.ceil(at)

    def holds(pos: Column) -> Column:
        return (pos >= F.col("__upto") - F.col("__c")) & (pos < F.col("__upto"))

    picked = run.filter(holds(low) | holds(high))
    lo = F.max(F.when(holds(low), F.col(value)))
    hi = F.max(F.when(holds(high), F.col(value)))
    frac = F.max(at - low)
    return picked.groupBy(*group).agg(_between(lo, hi, frac).alias(out))


# Bins of a histogram, and histograms that are drawn before the rest goes by distinct values.
BINS, PASSES = 1024, 3
# Groups above which their bounds are joined by exchange, not by broadcast.
BROADCAST_GROUPS = 100_000


def _bin(v: Column) -> Column:
    """Number of the bin of v between __lo and __hi, rising with v; infinite values and NaN have bins of their own."""
    x, lo, hi = v.cast("double"), F.col("__lo"), F.col("__hi")
    # Halved, so that the width of the whole range of doubles stays finite.
    width = F.when(hi > lo, hi / 2 - lo / 2)
    inside = F.least(F.floor((x / 2 - lo / 2) / width * BINS), F.lit(BINS - 1)) + 1
    return (
        F.when(F.isnan(x), BINS + 2).when(x < lo, 0).when(x > hi, BINS + 1).when(hi > lo, inside).otherwise(1).cast("long")
    )


def _narrowed(df: DataFrame, group: list[str], value: str, p: float, out: str, task_rows: int, bounds: DataFrame) -> DataFrame:
    """Quantile of large groups by selection: a histogram per group, then only the bin that holds the ranks, and again.

    A pass sends at most BINS + 3 rows per group and task through an exchange, however many distinct values there are. After
    PASSES, or when the bin holds one value, what is left goes by distinct values, with the number of rows below it.
    bounds: the group's columns, `__size`, and the finite extremes `__lo` and `__hi`.
    """
    v = F.col(value)
    few = bounds.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    renamed = {g: f"__k_{g}" for g in group}
    at = F.lit(p) * (F.col("__size") - 1)
    targets = F.array(F.floor(at), F.ceil(at))
    state = save(bounds.withColumns({"__below": F.lit(0).cast("long")}), "bounds")
    settled = []

    def join(rows: DataFrame, side: DataFrame) -> DataFrame:
        side = side.withColumnsRenamed(renamed)
        on = F.lit(True)
        for g in group:
            on = on & F.col(g).eqNullSafe(F.col(f"__k_{g}"))
        return rows.join(F.broadcast(side) if few else side, on).drop(*renamed.values())

    for _ in range(PASSES):
        bins = join(df.select(*group, value), state).withColumn("__bin", _bin(v))
        counts = bins.groupBy(*group, "__bin").agg(
            F.count(F.lit(1)).alias("__c"), F.min(v).alias("__min"), F.max(v).alias("__max"),
            *[F.first(c).alias(c) for c in ("__below", "__size")],
        )
        # At most BINS + 3 rows a group.
        upto = Window.partitionBy(*group).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("__upto", F.sum("__c").over(upto) + F.col("__below"))
        first = F.col("__upto") - F.col("__c")
        hit = counts.withColumn("__rank", F.explode(targets)).filter((F.col("__rank") >= first) & (F.col("__rank") < F.col("__upto")))
        # The ends of a bin are known; a rank between them needs a finer histogram.
        known = F.when(F.col("__rank") == first, F.col("__min")).when(F.col("__rank") == F.col("__upto") - 1, F.col("__max"))
        hit = hit.withColumn("__v", F.coalesce(known, F.when(F.col("__min") == F.col("__max"), F.col("__min"))))
        # Both ranks are in one bin, or the lower one ends its bin and the upper one begins the next.
        per = hit.groupBy(*group).agg(
            F.max("__size").alias("__size"),
            F.count_if(F.col("__v").isNull()).alias("__open"),
            F.min_by("__v", "__rank").alias("__vlo"),
            F.max_by("__v", "__rank").alias("__vhi"),
            F.min_by("__min", F.when(F.col("__v").isNull(), F.col("__rank"))).cast("double").alias("__lo"),
            F.min_by("__max", F.when(F.col("__v").isNull(), F.col("__rank"))).cast("double").alias("__hi"),
            F.min_by(first, F.when(F.col("__v").isNull(), F.col("__rank"))).alias("__below"),
        )
        per = save(per, "selection")
        done = per.filter(F.col("__open") == 0)
        settled.append(done.select(*group, _between(F.col("__vlo"), F.col("__vhi"), at - F.floor(at)).alias(out)))
        state = per.filter(F.col("__open") > 0).select(*group, "__lo", "__hi", "__size", "__below")
        if state.isEmpty():
            break
        # Only the bin's rows go on.
        inside = join(df.select(*group, value), state).filter((v >= F.col("__lo")) & (v <= F.col("__hi")))
        df = save(inside.select(*group, value), "narrowed")
    else:
        rest = join(df, state.select(*group, "__size", "__below"))
        settled.append(_by_value(rest, group, value, p, out, task_rows))
    return functools.reduce(DataFrame.unionByName, settled)


def exact_quantile(df: DataFrame, group: list[str], value: str, p: float, out: str, task_rows: int | None = None) -> DataFrame:
    """Exact quantile (linear interpolation) per group; nulls do not count, NaN is the largest value.

    Groups of up to task_rows rows go by their distinct values, larger ones by selection in histograms.
    """
    task_rows = TASK_ROWS if task_rows is None else task_rows
    v = F.col(value)
    rows = df.filter(v.isNotNull()).select(*group, value)
    one = [] if group else ["__all"]
    if one:
        rows = rows.withColumn("__all", F.lit(1))
    keys = group or one
    x = v.cast("double")
    finite = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    sizes = save(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"), F.min(finite).alias("__lo"), F.max(finite).alias("__hi")), "sizes")
    large = sizes.filter(F.col("__size") > task_rows)
    if large.isEmpty():
        return _by_value(rows, keys, value, p, out, task_rows).drop(*one)
    # A group without a finite value has no bounds; any will do, since its values are bins of their own.
    large = large.fillna(0.0, ["__lo", "__hi"])
    rows = save(rows, "values")
    on = functools.reduce(operator.and_, [F.col(g).eqNullSafe(F.col(f"__k_{g}")) for g in keys])
    hot = large.select(*[F.col(g).alias(f"__k_{g}") for g in keys])
    found = _narrowed(rows, keys, value, p, out, task_rows, large)
    if not sizes.filter(F.col("__size") <= task_rows).isEmpty():
        found = found.unionByName(_by_value(rows.join(hot, on, "left_anti"), keys, value, p, out, task_rows))
    return found.drop(*one)


def average_rank(
    df: DataFrame, group: list[str], value: str, out: str, descending: bool = False, task_rows: int | None = None
) -> DataFrame:
    """Average rank of value inside group (ties share the mean rank), and the group's non-null count as `<out>_n`."""
    task_rows = TASK_ROWS if task_rows is None else task_rows
    n = f"{out}_n"
    v = F.col(value)
    order = v.desc_nulls_last() if descending else v.asc_nulls_last()
    key = [F.col(g) for g in group] or [F.lit(1)]
    if group_sizes(df, group)[0] <= task_rows:
        rank = F.rank().over(Window.partitionBy(*key).orderBy(order))
        ties = F.count(v).over(Window.partitionBy(*key, v))
        return df.withColumns(
            {
                out: F.when(v.isNotNull(), rank + (ties - 1) / F.lit(2.0)),
                n: F.count(v).over(Window.partitionBy(*key)),
            }
        )
    counts = df.filter(v.isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__c"))
    ranked = ordered_running_sum(counts, group, [order], {"__upto": F.col("__c")}, {n: "__upto"}, task_rows)
    ranks = ranked.select(
        *[F.col(g).alias(f"__k_{g}") for g in group],
        v.alias("__k_value"),
        F.col("__c").alias("__k_c"),
        (F.col("__upto") - F.col("__c") + (F.col("__c") + 1) / F.lit(2.0)).alias(out),
        n,
    )
    ranks = save(ranks, "ranks")
    on = v == F.col("__k_value")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__k_{g}"))
    # A value that alone fills a task would be a hot join key. There are at most rows / task_rows such values, so
    # they are joined by broadcast, and only the others by exchange.
    hot = ranks.filter(F.col("__k_c") > task_rows)
    heavy = df.join(F.broadcast(hot), on)
    light = df.join(F.broadcast(hot), on, "left_anti").join(ranks.filter(F.col("__k_c") <= task_rows), on, "left")
    joined = heavy.unionByName(light)
    return joined.drop("__k_value", "__k_c", *[f"__k_{g}" for g in group])
