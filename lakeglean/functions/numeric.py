"""Numeric expressions with an explicit policy for what is unknown (null, never NaN)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A denominator is usable if it is greater.
FLOOR = 100


def floored_ratio(num: Column, den: Column, floor: float = FLOOR) -> Column:
    """num / den where den > floor, else null."""
    return F.when(den > floor, num.cast("double") / den)


def unusable(den: Column, floor: float = FLOOR) -> Column:
    return (den <= floor).cast("bigint")


def pop_std(values: list[Column]) -> Column:
    """Row-wise population standard deviation; null unless all values are known."""
    n = float(len(values))
    mean = reduce(Column.__add__, values) / n
    return F.sqrt(reduce(Column.__add__, [F.pow(v - mean, F.lit(2.0)) for v in values]) / n)


def slope(values: list[Column]) -> Column:
    """Least-squares slope over equally spaced values in chronological order, in closed form."""
    k = len(values)
    centre = (k - 1) / 2
    weights = [i - centre for i in range(k)]
    total = sum(w * w for w in weights)
    return reduce(Column.__add__, [v * (w / total) for v, w in zip(values, weights, strict=True)])


def leading_run(flags: list[Column]) -> Column:
    """How many of the first flags are 1 without a gap."""
    run, out = F.lit(1), F.lit(0)
    for f in flags:
        run = run * f.cast("int")
        out = out + run
    return out.cast("bigint")


def cap(value: Column, bound: Column) -> Column:
    """The lesser of both; an unknown value stays unknown (``least`` would give the bound)."""
    return F.when(value > bound, bound).otherwise(value)


def right_closed(value: Column, edges: list[float], labels: list[str], outside: str) -> Column:
    """Label of the interval (edge, next edge] that holds the value."""
    out = F.lit(outside)
    for lo, hi, label in reversed(list(zip(edges[:-1], edges[1:], labels, strict=True))):
        out = F.when((value > lo) & (value <= hi), F.lit(label)).otherwise(out)
    return out


def left_closed_index(value: Column, edges: list[float]) -> Column:
    """Number of edges at or below the value."""
    return reduce(Column.__add__, [(value >= F.lit(e)).cast("int") for e in edges], F.lit(0))
