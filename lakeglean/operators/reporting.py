"""Tables and texts of reports: numbers as text, contrasts of arms, states of parallel branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _given(x: Column, text: Column) -> Column:
    return F.when(x.isNotNull(), text)


def count_text(x: Column) -> Column:
    """A whole number with commas between thousands; null stays null, as in all of these."""
    return _given(x, F.format_string("%,d", x.cast("bigint")))


def amount_text(x: Column) -> Column:
    """An amount in whole units, halves to even, with commas between thousands."""
    return _given(x, F.format_string("%,.0f", F.bround(x.cast("double"), 0)))


def percent_text(x: Column) -> Column:
    """A share as a percentage with two decimals; ties of the decimal form go to even."""
    return _given(x, F.concat(F.format_string("%.2f", F.bround(x.cast("double") * 100, 2)), F.lit("%")))


def ratio_text(x: Column) -> Column:
    """A ratio with three decimals; ties of the decimal form go to even."""
    return _given(x, F.format_string("%.3f", F.bround(x.cast("double"), 3)))


def contrast(df: DataFrame, arm: str, metrics: list[str], arms: list[str]) -> DataFrame:
    """(metric, one column an arm) of a table with one row an arm; several rows of one are averaged.

    The arms are given, so no job looks for them and the columns don't depend on the data; an arm
    without rows is null.
    """
    long = df.select(arm, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(arm, metrics, "metric", "value")
    return long.groupBy("metric").pivot(arm, arms).agg(F.avg("value"))


def running_state(df: DataFrame, keys: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """``df`` with ``position`` and running totals of ``sums``, per run: the state after each append.

    Parallel branches append events and add to counters; the last position of a run holds its final
    state.  Appended events stay rows, so a long run is sorted and spilled, never gathered.
    ``order`` must tell the events of a run apart.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({"position": F.row_number().over(by), **{f"{c}_total": F.sum(F.coalesce(F.col(c), F.lit(0))).over(so_far) for c in sums}})
