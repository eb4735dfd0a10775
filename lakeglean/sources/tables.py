"""Tables of the credit data and of runs: CSV, Parquet, JSON and whole-text readers, idempotent writers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import contract as C


class SourceError(ValueError):
    """A source is missing or isn't what it should be."""


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """The raw CSV under its contract; malformed rows fail, types are never inferred."""
    if not exists(spark, path):
        raise SourceError(f"{path} is missing: download the table first")
    return spark.read.schema(C.CONTRACT.raw_struct()).option("header", True).option("mode", "FAILFAST").csv(path)


def read_working(spark: SparkSession, path: str) -> DataFrame:
    return C.canonical(read_raw(spark, path))


def check_legend(delivered: list[str], expected: list[str]) -> list[str]:
    """Expected order of columns if both name the same ones."""
    if set(delivered) != set(expected):
        raise SourceError(f"columns differ: {sorted(set(delivered) ^ set(expected))}")
    return list(expected)


def write_csv(df: DataFrame, path: str, force: bool = False) -> bool:
    """Write once; False if it exists and isn't forced.  The committer makes the result whole or absent."""
    if exists(df.sparkSession, path) and not force:
        return False
    df.write.mode("overwrite").option("header", True).csv(path)
    return True


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_json_applicants(spark: SparkSession, path: str) -> DataFrame:
    """One object or an array of objects per file."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in C.PREDICTORS])
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def applicants_from_text(df: DataFrame, text: str) -> DataFrame:
    """``df`` and the parsed applicant; unknown and malformed fields are null, extras are named."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in C.PREDICTORS])
    known = F.array(*map(F.lit, C.PREDICTORS))
    return df.withColumn("applicant", F.from_json(F.col(text), schema)).withColumn("extras", F.array_except(F.json_object_keys(F.col(text)), known))


def by_id(df: DataFrame, ids: list[int], key: str = "ID") -> DataFrame:
    """The rows of some ids; an id without row is an error.  Runs a count of at most len(ids) rows."""
    found = df.where(F.col(key).isin(ids))
    missing = set(ids) - {r[0] for r in found.select(key).collect()}
    if missing:
        raise SourceError(f"no such id: {sorted(missing)}")
    return found


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the Markdown files of a folder; a folder without any is an error."""
    if not exists(spark, path):
        raise SourceError(f"{path} is missing")
    df = spark.read.option("wholetext", True).option("pathGlobFilter", "*.md").text(path)
    if df.isEmpty():
        raise SourceError(f"{path} has no Markdown file")
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_artefact(spark: SparkSession, path: str) -> DataFrame:
    """A report's CSV file as a table of strings; its first column is the index and comes first as ``index``."""
    if not exists(spark, path):
        raise SourceError(f"{path} is missing")
    df = spark.read.option("header", True).csv(path)
    return df.withColumnRenamed(df.columns[0], "index")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; an absent folder is an empty table."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


RUNS = "run_id string, name string, run_type string, metrics map<string,double>, params map<string,string>, tags map<string,string>"


def append_run(spark: SparkSession, path: str, run_id: str, name: str, run_type: str, metrics: dict, params: dict, tags: dict) -> None:
    row = [(run_id, name, run_type, {k: float(v) for k, v in metrics.items()}, {k: str(v) for k, v in params.items()}, {k: str(v) for k, v in tags.items()})]
    spark.createDataFrame(row, RUNS).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS).parquet(path)


def unique_run(runs: DataFrame, run_type: str, name: str) -> dict:
    """The one run of a type and name, or an error that lists candidates."""
    got = runs.where((F.col("run_type") == run_type) & (F.col("name") == name)).limit(2).collect()
    if len(got) != 1:
        near = [r[0] for r in runs.where(F.col("run_type") == run_type).select("name").distinct().limit(20).collect()]
        raise SourceError(f"{len(got)} runs are {run_type}/{name}; there are {near}")
    return got[0].asDict()


def redact(uri: str) -> str:
    return re.sub(r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@?#]*@", r"\1", uri)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A bounded table as padded Markdown; one of more than ``most`` rows is an error."""
    got = df.limit(most + 1).collect()
    if len(got) > most:
        raise SourceError(f"more than {most} rows")
    rows = [list(map(str, df.columns)), *[["" if v is None else (f"{v:,.4f}" if isinstance(v, float) else str(v)) for v in r] for r in got]]
    widths = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    lines = ["| " + " | ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)) + " |" for r in rows]
    return "\n".join([lines[0], "|" + "|".join("-" * (w + 2) for w in widths) + "|", *lines[1:]])


def questions(spark: SparkSession, items: list[dict]) -> DataFrame:
    """An evaluation set (id, question, gold, tags); repeated ids and missing keys are errors."""
    seen: set[str] = set()
    for q in items:
        if missing := [k for k in ("id", "question", "expected_chunk_ids") if k not in q]:
            raise SourceError(f"missing keys: {missing}")
        if q["id"] in seen:
            raise SourceError(f"repeated id {q['id']}")
        seen.add(q["id"])
    rows = [(q["id"], q["question"], list(q["expected_chunk_ids"] or []), list(q.get("tags") or [])) for q in items]
    return spark.createDataFrame(rows, "id string, question string, gold array<string>, tags array<string>")


