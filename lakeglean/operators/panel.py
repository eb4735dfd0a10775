"""Behavioural features of the monthly panel: pure projections, no shuffle.

Month 1 is the most recent; month m + 1 comes before month m.  Months 2 to 6 are the homogeneous
block; month 1 is read by its own features only.
"""

from __future__ import annotations

import re

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N

BLOCK = range(2, 7)
RATIO_MONTHS = range(2, 6)
DELINQUENT = 1
THRESHOLD = 0.160
FEATURES = (
    *(f"UTILIZATION_M{m}" for m in BLOCK),
    *(f"PAYMENT_RATIO_M{m}" for m in RATIO_MONTHS),
    *(f"PAYMENT_RATIO_NOT_COMPUTABLE_M{m}" for m in RATIO_MONTHS),
    "UTILIZATION_TREND",
    "DELINQUENCY_STREAK",
    "MAX_DELINQUENCY",
    "BILL_VOLATILITY",
    "UTILIZATION_VOLATILITY",
    "MONTHS_WITHOUT_PAYMENT",
    "UTILIZATION_MOST_RECENT_M1",
    "IS_DELINQUENT_MOST_RECENT_M1",
    "UTILIZATION_NOT_COMPUTABLE",
)


def _cols(prefix: str, months) -> list[Column]:
    return [F.col(f"{prefix}{m}") for m in months]


def utilization(limit: str = "LIMIT_BAL") -> dict[str, Column]:
    return {f"UTILIZATION_M{m}": N.floored_ratio(F.col(f"BILL_AMT{m}"), F.col(limit)) for m in BLOCK}


def payment_ratio() -> dict[str, Column]:
    """What was paid in a month against the bill of the month before, and whether that is unusable."""
    out = {f"PAYMENT_RATIO_M{m}": N.floored_ratio(F.col(f"PAY_AMT{m}"), F.col(f"BILL_AMT{m + 1}")) for m in RATIO_MONTHS}
    return out | {f"PAYMENT_RATIO_NOT_COMPUTABLE_M{m}": N.unusable(F.col(f"BILL_AMT{m + 1}")) for m in RATIO_MONTHS}


def summaries() -> dict[str, Column]:
    """Features over the whole block; the utilisations must be columns already."""
    chronological = [F.col(f"UTILIZATION_M{m}") for m in reversed(BLOCK)]
    return {
        "UTILIZATION_TREND": N.slope(chronological),
        "DELINQUENCY_STREAK": N.leading_run([s >= DELINQUENT for s in _cols("PAY_STATUS_", BLOCK)]),
        "MAX_DELINQUENCY": F.greatest(F.lit(0).cast("bigint"), *_cols("PAY_STATUS_", BLOCK)),
        "BILL_VOLATILITY": N.pop_std([c.cast("double") for c in _cols("BILL_AMT", BLOCK)]),
        "UTILIZATION_VOLATILITY": N.pop_std(chronological),
        "MONTHS_WITHOUT_PAYMENT": reduce(Column.__add__, [(c == 0).cast("bigint") for c in _cols("PAY_AMT", BLOCK)]),
    }


def isolated() -> dict[str, Column]:
    return {
        "UTILIZATION_MOST_RECENT_M1": N.floored_ratio(F.col("BILL_AMT1"), F.col("LIMIT_BAL")),
        "IS_DELINQUENT_MOST_RECENT_M1": (F.col("PAY_STATUS_1") >= DELINQUENT).cast("bigint"),
        "UTILIZATION_NOT_COMPUTABLE": N.unusable(F.col("LIMIT_BAL")),
    }


def features(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all, if None) and the 22 features, in their fixed order."""
    kept = df.columns if keep is None else keep
    if clash := [c for c in FEATURES if c in kept]:
        raise ValueError(f"columns exist already: {clash}")
    needed = ["LIMIT_BAL", *(f"PAY_STATUS_{m}" for m in range(1, 7)), *(f"BILL_AMT{m}" for m in range(1, 7)), *(f"PAY_AMT{m}" for m in BLOCK)]
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    wide = df.withColumns(utilization() | payment_ratio() | isolated()).withColumns(summaries())
    return wide.select(*kept, *FEATURES)


def decision(probability: Column, threshold: float = THRESHOLD) -> Column:
    return F.when(probability >= threshold, F.lit("refuse")).otherwise(F.lit("approve"))


def month_of(column: str) -> int:
    """The month that a column's name ends with."""
    found = re.search(r"(\d+)$", column)
    if not found:
        raise ValueError(f"{column} names no month")
    return int(found[1])


def by_month(df: DataFrame, key: str) -> DataFrame:
    """(key, column, month, value): a row for each column whose name ends with a month, of every row; an error without any."""
    columns = [c for c in df.columns if c != key and re.search(r"\d$", c)]
    if not columns:
        raise ValueError("no column names a month")
    long = df.unpivot(key, columns, "column", "value")
    return long.select(key, "column", F.regexp_extract("column", r"(\d+)$", 1).cast("bigint").alias("month"), "value")


def split_target(df: DataFrame, target: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(features, labels): ``df`` without the target, and (key, target), which rows are matched by."""
    if missing := [c for c in (target, key) if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    return df.drop(target), df.select(key, target)


def resolve_source(column: str, sources: list[str]) -> str:
    """The source that a matrix column belongs to: its exact name, else the only prefix ``source_``."""
    if column in sources:
        return column
    owners = [s for s in sources if column.startswith(f"{s}_")]
    if len(owners) != 1:
        raise ValueError(f"{column}: {len(owners)} sources claim it")
    return owners[0]


def select_group(df: DataFrame, sources: list[str], group: list[str]) -> DataFrame:
    """Matrix columns whose source is in the group, in their order."""
    chosen = [c for c in df.columns if resolve_source(c, sources) in group]
    if not chosen:
        raise ValueError("no column is left")
    return df.select(*chosen)


def scenario(df: DataFrame, changes: dict[str, float], score, known: list[str]) -> DataFrame:
    """``df`` with baseline, scenario and delta of ``score`` (a function of columns by name) after
    overwriting given predictors."""
    if not changes:
        raise ValueError("a scenario changes something")
    if unknown := [c for c in changes if c not in known]:
        raise ValueError(f"not predictors: {unknown}")
    base = {c: F.col(c) for c in known}
    after = score(base | {c: F.lit(v) for c, v in changes.items()})
    return df.withColumns({"baseline": score(base), "scenario": after}).withColumn("delta", F.col("scenario") - F.col("baseline"))
