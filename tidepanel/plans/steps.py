"""A user's own feature steps: declared reads and outputs, put in order and run together on the exchange of the built-in features."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.windows import CODE, DATE, Stages, run_stages


@dataclass(frozen=True)
class Step:
    """Per-code features that look at one code at a time.

    reads: columns used, of the panel, of the built-in features or of other steps. makes: columns added. stages: given the names of
    the present columns and the run's settings, the expressions level by level (see functions.windows); helpers begin with `__`. A step whose
    `optional` reads are absent is still run, and finds out by the names; absent `reads` are an error.
    """

    name: str
    reads: tuple[str, ...]
    makes: tuple[str, ...]
    stages: Callable[[set[str], Any], Stages]
    optional: tuple[str, ...] = ()


def in_order(steps: tuple[Step, ...], columns: list[str]) -> list[Step]:
    """Each step after those whose outputs it reads, otherwise as given. Clashes, absent columns and cycles are errors."""
    maker: dict[str, Step] = {}
    names: set[str] = set()
    for step in steps:
        if step.name in names:
            raise ValueError(f"there are two steps {step.name!r}")
        names.add(step.name)
        for c in step.makes:
            if c in maker:
                raise ValueError(f"steps {maker[c].name!r} and {step.name!r} both make {c!r}")
            if c in columns:
                raise ValueError(f"step {step.name!r} makes {c!r}, which is there already")
            maker[c] = step
    for step in steps:
        missing = [c for c in step.reads if c not in maker and c not in columns]
        if missing:
            raise RuntimeError(f"step {step.name!r} lacks {missing}")
    order: list[Step] = []
    waiting = list(steps)
    while waiting:
        made = {c for s in order for c in s.makes}
        ready = next((s for s in waiting if all(c in made or c not in maker for c in (*s.reads, *s.optional))), None)
        if ready is None:
            raise ValueError(f"steps {[s.name for s in waiting]} read each other's outputs in a cycle")
        order.append(ready)
        waiting.remove(ready)
    return order


def run_steps(df: DataFrame, steps: tuple[Step, ...], cfg: Any = None) -> DataFrame:
    """All steps in one chain of projections on the partitioning of df, which is by code.

    A step starts one level after the last step that it reads from, so steps that do not depend on each other share window
    operators, and all of them share one sort. Columns that no step reads ride along packed in one struct.
    """
    order = in_order(steps, df.columns)
    if not order:
        return df
    wanted = {CODE, DATE, *(c for s in order for c in (*s.reads, *s.optional))}
    kept = [c for c in df.columns if c in wanted]
    rest = [c for c in df.columns if c not in wanted]
    present, ends, owner, parts = set(kept), {}, {}, []
    for step in order:
        begin = max((ends[c] for c in (*step.reads, *step.optional) if c in ends), default=0)
        stages = step.stages(present, cfg)
        outputs = [c for level in stages for c in level]
        unsaid = {c for c in outputs if not c.startswith("__")} ^ set(step.makes)
        if unsaid and stages:
            raise ValueError(f"step {step.name!r} makes other columns than it declares: {sorted(unsaid)}")
        for c in outputs:
            if owner.setdefault(c, step.name) != step.name:
                raise ValueError(f"steps {owner[c]!r} and {step.name!r} both use {c!r}")
        if stages:
            ends |= {c: begin + len(stages) for c in step.makes}
            present |= set(step.makes)
        parts.append([*[{}] * begin, *stages])
    narrow = df.select(*kept, F.struct(*rest).alias("__rest__")) if rest else df
    made = run_stages(narrow, *parts)
    new = [c for c in made.columns if c not in kept and c != "__rest__"]
    return made.select(*kept, *new, *([F.col("__rest__.*")] if rest else []))
