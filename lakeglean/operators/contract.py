"""Closed column contract of the credit table, and validation with graded findings.

All checks accumulate; none changes its input.  A check that counts rows is one aggregation over the
table, whatever the number of columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BLOCKING, INFORMATIVE = "blocking", "informative"
MONTHS = range(1, 7)
#: The admissible codes and ranges of the credit table.
STATUS = tuple(f"PAY_STATUS_{m}" for m in MONTHS)
BILLS = tuple(f"BILL_AMT{m}" for m in MONTHS)
PAYMENTS = tuple(f"PAY_AMT{m}" for m in MONTHS)
TARGET = "DEFAULT_PAYMENT_NEXT_MONTH"
PREDICTORS = ("LIMIT_BAL", "SEX", "EDUCATION", "MARRIAGE", "AGE", *STATUS, *BILLS, *PAYMENTS)
WORKING = (*PREDICTORS, TARGET)
CANONICAL = ("ID", *WORKING)
RAW_NAMES = {"PAY_0": "PAY_STATUS_1", **{f"PAY_{m}": f"PAY_STATUS_{m}" for m in range(2, 7)}, "default payment next month": TARGET}
DECLARED = {"SEX": (1, 2), "EDUCATION": (1, 2, 3, 4), "MARRIAGE": (1, 2, 3), **{c: (-1, *range(1, 10)) for c in STATUS}, TARGET: (0, 1)}
ACCEPTED = {
    "EDUCATION": {0: "undocumented", 5: "undocumented", 6: "undocumented"},
    "MARRIAGE": {0: "undocumented"},
    **{c: {-2: "no consumption", 0: "revolving credit"} for c in STATUS},
}
RANGES = {"ID": (1, None), "LIMIT_BAL": (1, 5_000_000), "AGE": (18, 120), **{c: (-5_000_000, 5_000_000) for c in BILLS}, **{c: (0, 5_000_000) for c in PAYMENTS}}


class ContractError(ValueError):
    """The table breaks its contract; the message is the whole report."""


@dataclass(frozen=True)
class Contract:
    """Columns in order, declared and accepted codes, closed ranges."""

    columns: tuple[str, ...] = WORKING
    optional: tuple[str, ...] = ("ID",)
    declared: dict = field(default_factory=lambda: DECLARED)
    accepted: dict = field(default_factory=lambda: ACCEPTED)
    ranges: dict = field(default_factory=lambda: RANGES)

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.LongType()) for c in self.columns])

    def raw_struct(self) -> T.StructType:
        spelling = {v: k for k, v in RAW_NAMES.items()}
        return T.StructType([T.StructField(spelling.get(c, c), T.LongType()) for c in CANONICAL])


CONTRACT = Contract()
FINDING = "check string, severity string, column string, message string, counts map<string, bigint>"


def canonical(raw: DataFrame, drop_id: bool = True) -> DataFrame:
    """Raw spelling to canonical names; ``ID`` goes; no value changes."""
    out = raw.withColumnsRenamed({k: v for k, v in RAW_NAMES.items() if k in raw.columns})
    return out.drop("ID") if drop_id else out


def missing_columns(df: DataFrame, contract: Contract = CONTRACT) -> list[str]:
    return [c for c in contract.columns if c not in df.columns]


def unexpected_columns(df: DataFrame, contract: Contract = CONTRACT) -> list[str]:
    known = {*contract.columns, *contract.optional}
    return [c for c in df.columns if c not in known]


def dtype_mismatches(df: DataFrame, contract: Contract = CONTRACT) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema if f.name in contract.columns and f.dataType != T.LongType()}


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) of some integer columns: one row for each cell, by ``stack`` (no shuffle)."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS BIGINT)" for c in columns)
    return df.select(F.expr(f"stack({len(columns)}, {pairs}) AS (column, value)"))


def null_counts(df: DataFrame) -> DataFrame:
    """(column, n_null) of every column, zeros included; NaN counts as null."""
    unknown = {f.name: F.col(f"`{f.name}`").isNull() | (F.isnan(F.col(f"`{f.name}`")) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.lit(False)) for f in df.schema}
    one = df.agg(*[F.count_if(test).alias(f"n{i}") for i, test in enumerate(unknown.values())])
    pairs = ", ".join(f"'{c}', n{i}" for i, c in enumerate(unknown))
    return one.select(F.expr(f"stack({len(unknown)}, {pairs}) AS (column, n_null)"))


def _levels(df: DataFrame, levels: dict) -> DataFrame:
    rows = [(c, int(v), str(m)) for c, values in levels.items() for v, m in (values.items() if isinstance(values, dict) else ((v, "declared") for v in values))]
    return df.sparkSession.createDataFrame(rows, "column string, value bigint, meaning string")


def category_counts(df: DataFrame, contract: Contract = CONTRACT) -> DataFrame:
    """(column, value, n) of coded columns that are present; partial sums before the shuffle."""
    coded = [c for c in contract.declared if c in df.columns]
    return _long(df, coded).where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))


def unknown_categories(df: DataFrame, contract: Contract = CONTRACT, most: int = 20) -> DataFrame:
    """(column, value, n, place): codes neither declared nor accepted, the most frequent first."""
    known = _levels(df, contract.declared).unionByName(_levels(df, contract.accepted)).select("column", "value")
    unknown = category_counts(df, contract).join(F.broadcast(known), ["column", "value"], "left_anti")
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), F.col("value").cast("string")))
    return unknown.withColumn("place", place).where(F.col("place") <= most)


def accepted_categories(df: DataFrame, contract: Contract = CONTRACT) -> DataFrame:
    """(column, meaning, codes, n): accepted undocumented codes, grouped by meaning."""
    hits = category_counts(df, contract).join(F.broadcast(_levels(df, contract.accepted)), ["column", "value"])
    return hits.groupBy("column", "meaning").agg(F.array_sort(F.collect_list("value")).alias("codes"), F.sum("n").alias("n"))


def range_findings(df: DataFrame, contract: Contract = CONTRACT) -> DataFrame:
    """(column, below, above, least, greatest) of each numeric column with a range."""
    ranged = [c for c in contract.ranges if c in df.columns and isinstance(df.schema[c].dataType, T.NumericType)]
    aggs = []
    for i, c in enumerate(ranged):
        lo, hi = contract.ranges[c]
        x = F.col(c)
        aggs += [
            F.count_if(x < lo).alias(f"b{i}") if lo is not None else F.lit(0).cast("bigint").alias(f"b{i}"),
            F.count_if(x > hi).alias(f"a{i}") if hi is not None else F.lit(0).cast("bigint").alias(f"a{i}"),
            F.min(x).alias(f"l{i}"),
            F.max(x).alias(f"g{i}"),
        ]
    parts = ", ".join(f"'{c}', b{i}, a{i}, l{i}, g{i}" for i, c in enumerate(ranged))
    return df.agg(*aggs).select(F.expr(f"stack({len(ranged)}, {parts}) AS (column, below, above, least, greatest)"))


def duplicate_rows(df: DataFrame, ignoring: tuple[str, ...] = ()) -> DataFrame:
    """One row (n_duplicates): sum of copies - 1 over fully equal rows.

    Rows are compared by a 256-bit digest of their cells, so wide texts don't travel.
    """
    cells = [c for c in df.columns if c not in ignoring]
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in cells]), {"ignoreNullFields": "false"}), 256)
    copies = df.select(digest.alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"))


def validate(df: DataFrame, contract: Contract = CONTRACT) -> DataFrame:
    """Every finding of every check: (check, severity, column, message, counts)."""
    spark = df.sparkSession
    rows = [("missing_columns", BLOCKING, c, f"column {c} is missing", {}) for c in missing_columns(df, contract)]
    rows += [("unexpected_columns", BLOCKING, c, f"column {c} is not in the contract", {}) for c in unexpected_columns(df, contract)]
    rows += [("dtype_mismatch", BLOCKING, c, f"column {c} is {t}, not bigint", {}) for c, t in dtype_mismatches(df, contract).items()]
    rows += [("range_check_skipped", INFORMATIVE, c, f"column {c} is not numeric", {}) for c in contract.ranges if c in df.columns and not isinstance(df.schema[c].dataType, T.NumericType)]
    if "ID" not in df.columns:
        rows.append(("exact_duplicate_check_skipped", INFORMATIVE, None, "no identifier column", {}))
    known = df.select(*[c for c in df.columns if c in {*contract.columns, *contract.optional}])
    nulls = null_counts(df)
    parts = [
        spark.createDataFrame(rows, FINDING),
        nulls.where("n_null > 0").select(F.lit("null_values"), F.lit(BLOCKING), "column", F.lit("null values"), F.create_map("column", "n_null")),
        unknown_categories(known, contract)
        .groupBy("column")
        .agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("place", "value", "n"))), lambda x: F.struct(x["value"].cast("string"), x["n"]))).alias("counts"))
        .select(F.lit("unknown_category"), F.lit(BLOCKING), "column", F.lit("unknown codes"), "counts"),
        accepted_categories(known, contract).select(F.lit("accepted_undocumented_category"), F.lit(INFORMATIVE), "column", "meaning", F.create_map("meaning", "n")),
        range_findings(known, contract)
        .where("below + above > 0")
        .select(F.lit("out_of_range"), F.lit(BLOCKING), "column", F.format_string("observed %s to %s", F.col("least").cast("string"), F.col("greatest").cast("string")), F.create_map(F.lit("below"), "below", F.lit("above"), "above")),
    ]
    if "ID" in df.columns:
        for name, severity, ignoring in (("duplicate_rows", BLOCKING, ()), ("duplicate_rows_ignoring_id", INFORMATIVE, ("ID",))):
            found = duplicate_rows(df, ignoring).where("n_duplicates > 0")
            parts.append(found.select(F.lit(name), F.lit(severity), F.lit(None).cast("string"), F.lit("equal rows"), F.create_map(F.lit("rows"), "n_duplicates")))
    return reduce(DataFrame.union, parts)


def validate_or_raise(df: DataFrame, contract: Contract = CONTRACT) -> DataFrame:
    """The findings if none blocks; else an error that names all.  Runs the checks."""
    found = validate(df, contract)
    rows = found.collect()
    if any(r["severity"] == BLOCKING for r in rows):
        raise ContractError("\n".join(f"{r['check']} [{r['severity']}] {r['column'] or ''}: {r['message']} {dict(r['counts'] or {})}" for r in rows))
    return found


def _offences(columns: list[str], contract: Contract) -> list[Column]:
    """A text or null for each column: a code that isn't known, else a value out of its closed range."""
    tests = []
    for c in columns:
        if c in contract.declared:
            levels = [*contract.declared[c], *contract.accepted.get(c, {})]
            tests.append(F.when(F.col(c).isNull() | ~F.col(c).isin(levels), F.lit(f"{c}: unknown code")))
        elif c in contract.ranges:
            lo, hi = contract.ranges[c]
            bad = F.col(c).isNull()
            bad = bad | (F.col(c) < lo) if lo is not None else bad
            bad = bad | (F.col(c) > hi) if hi is not None else bad
            tests.append(F.when(bad, F.lit(f"{c}: out of range")))
    return tests


def reject_reason(columns: list[str], contract: Contract = CONTRACT) -> Column:
    """First offence of a row, or null."""
    return F.coalesce(*_offences(columns, contract))


def reject_reasons(columns: list[str], contract: Contract = CONTRACT) -> tuple[Column, Column]:
    """(fields, reasons) of all offences of a row: arrays without repeats, in the order of ``columns``."""
    every = F.array_compact(F.array(*_offences(columns, contract)))
    fields = F.array_distinct(F.transform(every, lambda x: F.split_part(x, F.lit(": "), F.lit(1))))
    return fields, F.array_distinct(F.transform(every, lambda x: F.split_part(x, F.lit(": "), F.lit(2))))


def strict_batch(df: DataFrame, contract: Contract = CONTRACT) -> DataFrame:
    """``df`` if every row is admissible; else an error naming problems.  Runs one bounded job."""
    bad = df.withColumn("__why", reject_reason([c for c in PREDICTORS if c in df.columns], contract)).where("__why IS NOT NULL")
    problems = bad.groupBy("__why").count().orderBy(F.desc("count"), "__why").limit(50).collect()
    if problems:
        raise ContractError("; ".join(f"{r['__why']} ({r['count']} rows)" for r in problems))
    return df
