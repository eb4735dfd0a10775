"""Statistics learned on one table and applied to another.

A fit gives one row; ``apply`` takes that row (as a DataFrame, broadcast: it is
one row whatever the input) or the parameters read from it.  All percentiles are exact, with linear
interpolation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import cap
from ..sources.shared import written
from . import panel
from .ranking import quantiles

CLIP_AT = 99.5
CLIPPED = tuple(f"PAYMENT_RATIO_M{m}" for m in panel.RATIO_MONTHS)
CATEGORICAL = ("SEX", "EDUCATION", "MARRIAGE", *(f"PAY_STATUS_{m}" for m in range(1, 7)))
INDICATORS = tuple(c for c in panel.FEATURES if "NOT_COMPUTABLE" in c or c.startswith("IS_"))
NUMERIC = (
    "LIMIT_BAL",
    "AGE",
    *(f"BILL_AMT{m}" for m in range(1, 7)),
    *(f"PAY_AMT{m}" for m in range(1, 7)),
    *(c for c in panel.FEATURES if c not in INDICATORS),
)
EDUCATION_COLLAPSE = {0: 4, 5: 4, 6: 4}


def recode(df: DataFrame, column: str = "EDUCATION", collapse: dict[int, int] | None = None) -> DataFrame:
    collapse = EDUCATION_COLLAPSE if collapse is None else collapse
    return df.replace(collapse, subset=[column])


def clip_bounds(df: DataFrame, columns=CLIPPED, percent: float = CLIP_AT, fixed: bool = False) -> DataFrame:
    """One row: the bound of each column; infinity where nothing is known.  ``fixed``: ``df`` is a written table."""
    if not 0 <= percent <= 100:
        raise ValueError("a percentile lies between 0 and 100")
    q = quantiles(df, {c: F.col(c) for c in columns}, [percent / 100], fixed=fixed)
    return q.select(*[F.coalesce(F.col(c)[0], F.lit(float("inf"))).alias(c) for c in columns])


def clip(df: DataFrame, bounds: dict[str, float]) -> DataFrame:
    return df.withColumns({c: cap(F.col(c), F.lit(b)) for c, b in bounds.items()})


@dataclass
class Preparation:
    """What the matrix needs to know: bounds, levels, medians, centres and widths."""

    bounds: dict[str, float] = field(default_factory=dict)
    levels: dict[str, list[int]] = field(default_factory=dict)
    medians: dict[str, float | None] = field(default_factory=dict)
    centres: dict[str, float] = field(default_factory=dict)
    widths: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, clipped=CLIPPED, categorical=CATEGORICAL, numeric=NUMERIC) -> Preparation:
        """One row at a time: bounds, levels, medians of clipped values, scales of imputed ones.  Columns are written once."""
        out = cls()
        df = written(df.select(*dict.fromkeys([*clipped, *categorical, *numeric])), "preparation")
        out.bounds = clip_bounds(df, clipped, fixed=True).first().asDict()
        levels = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in categorical]).first()
        out.levels = {c: list(levels[c]) for c in categorical}
        cut = clip(df, out.bounds)
        second = quantiles(cut, {c: F.col(c) for c in numeric}, [0.5], fixed=True).first()
        out.medians = {c: second[c] and second[c][0] for c in numeric}
        filled = cut.select(*[F.coalesce(F.col(c).cast("double"), F.lit(out.medians[c])).alias(c) for c in numeric])
        third = quantiles(filled, {c: F.col(c) for c in numeric}, [0.25, 0.5, 0.75], fixed=True).first()
        for c in numeric:
            low, mid, high = third[c] or (0.0, 0.0, 0.0)
            out.centres[c], out.widths[c] = mid, (high - low) or 1.0
        return out

    def matrix(self, df: DataFrame, keep: tuple[str, ...] = (), indicators=INDICATORS) -> DataFrame:
        """``keep`` and the dense float columns: levels, scaled numbers, indicators; no shuffle."""
        cut = clip(df, self.bounds)
        levels = [c for pairs in self.levels for c in one_hot(pairs, self.levels[pairs])]
        scaled = [((F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) - self.centres[c]) / self.widths[c]).alias(c) for c in self.centres]
        return cut.select(*keep, *levels, *scaled, *[F.col(c).cast("double").alias(c) for c in indicators])

    def report(self, spark) -> DataFrame:
        """(parameter, column, value) of what was learned."""
        rows = [(name, c, float(v)) for name, values in (("clip", self.bounds), ("median", self.medians), ("centre", self.centres), ("width", self.widths)) for c, v in values.items() if v is not None]
        return spark.createDataFrame(rows, "parameter string, column string, value double")


def one_hot(column: str, levels: list[int]) -> list[Column]:
    """All levels that the fit has seen; another value is all zeros."""
    return [F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)).alias(f"{column}_{v}") for v in levels]


def impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Unknown values become the column's median over ``df`` (one broadcast row)."""
    medians = quantiles(df, {f"__m_{c}": F.col(c) for c in columns}, [0.5])
    return df.crossJoin(F.broadcast(medians)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__m_{c}")[0]) for c in columns}).drop(*[f"__m_{c}" for c in columns])


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / (q75 - q25) over ``df``; a width of zero counts as 1 (one broadcast row)."""
    stats = quantiles(df, {f"__q_{c}": F.col(c) for c in columns}, [0.25, 0.5, 0.75])
    scaled = {}
    for c in columns:
        s = F.col(f"__q_{c}")
        width = F.when(s[2] - s[0] == 0, F.lit(1.0)).otherwise(s[2] - s[0])
        scaled[c] = (F.col(c).cast("double") - s[1]) / width
    return df.crossJoin(F.broadcast(stats)).withColumns(scaled).drop(*[f"__q_{c}" for c in columns])


def constant_columns(df: DataFrame) -> DataFrame:
    """(column): those with one value only, null counted as a value."""
    one = df.agg(*[((F.min(c).eqNullSafe(F.max(c))) & ((F.count(c) == 0) | (F.count(c) == F.count("*")))).alias(c) for c in df.columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return one.select(F.expr(f"stack({len(df.columns)}, {pairs}) AS (column, constant)")).where("constant").select("column")
