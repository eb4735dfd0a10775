"""Strict applicant records from JSON: every departure from the contract is named, nothing is imputed.

A record is an object with exactly the predictors, each a whole number: an integer, a number without
fraction, or either as a text, in plain digits.  Anything else (no object, a missing or unknown field, null, true, a fraction, a
list) is a problem; so is a code that the contract doesn't know and a value out of its range, looked at once the shape is right.
All checks are expressions on the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import contract as C


def fields(text: Column, known: tuple[str, ...] = C.PREDICTORS) -> Column:
    """A struct of the known fields' values as they stand in the text: one pass over it."""
    return F.from_json(text, ", ".join(f"`{c}` string" for c in known))


def whole(value: Column) -> Column:
    """A whole number's text as a bigint; null for any other text."""
    return F.when(value.rlike(r"^\s*[-+]?[0-9]{1,18}(\.0*)?\s*$"), F.split_part(F.trim(value), F.lit("."), F.lit(1)).try_cast("bigint"))


def shape_problems(keys: Column, known: tuple[str, ...] = C.PREDICTORS) -> Column:
    """An array of texts from a record's keys and, as columns, its known fields: unknown fields first, then what is wrong with known ones."""
    unknown = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, known)))), lambda k: F.concat(k, F.lit(": unknown field")))
    each = [F.when(~F.array_contains(keys, c), F.lit(f"{c}: missing")).when(F.col(c).isNull(), F.lit(f"{c}: not a whole number")) for c in known]
    return F.when(keys.isNotNull(), F.concat(unknown, F.array_compact(F.array(*each)))).otherwise(F.array(F.lit("not an object")))


def strict_records(df: DataFrame, text: str, known: tuple[str, ...] = C.PREDICTORS, contract: C.Contract = C.CONTRACT) -> DataFrame:
    """``df`` with ``applicant`` (a struct, null if refused) and ``problems`` (an array, empty if accepted)."""
    row = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("__row"), F.col(text).alias("__text"))
    # one parse for the fields and one for the keys, null where the text is no object
    row = row.withColumns({"__fields": fields(F.col("__text"), known), "__keys": F.when(F.try_parse_json("__text").isNotNull(), F.json_object_keys("__text"))})
    row = row.select("__row", "__keys", *[whole(F.col(f"__fields.{c}")).alias(c) for c in known])
    row = row.withColumn("__shape", shape_problems(F.col("__keys"), known))
    offences = F.array_compact(F.array(*C._offences(list(known), contract)))
    row = row.withColumn("__problems", F.when(F.size("__shape") > 0, F.col("__shape")).otherwise(offences))
    accepted = F.when(F.size("__problems") == 0, F.struct(*known))
    return row.select(*[F.col(f"__row.{c}").alias(c) for c in df.columns], accepted.alias("applicant"), F.col("__problems").alias("problems"))
