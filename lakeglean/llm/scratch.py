"""Shared-folder tables that cut lineage.

Everything that must be read more than once is written as Parquet below the folder that the
session names in ``spark.checkpoint.dir`` (all executors share it), and read back with an explicit
schema.  A lost executor then costs a re-read, never a recomputation of the whole plan, and no copy
lives on one machine only.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is set only where none is named, on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lakeglean-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


#: While a table is written: shuffle files go as soon as it is, and batches for Python stay small.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the time of a block; what was set before comes back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """A folder of intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a DataFrame that reads the written files."""
        path = f"{self.root}/{name}"
        with settings(self.spark, WRITING):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing lazy reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
