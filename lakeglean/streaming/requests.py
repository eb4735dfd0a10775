"""Request logs as a stream: windowed panels, admissibility, repeated ids, drift by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contract as C
from ..operators import drift


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def latency_panel(stream: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(window, n, mean, greatest, errors) of a log, batch or stream; later rows than the watermark are dropped."""
    timed = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return timed.groupBy(F.window(ts, width)).agg(F.count("*").alias("n"), F.avg("latency").alias("mean"), F.max("latency").alias("greatest"), F.count("error_type").alias("errors"))


def admissible(stream: DataFrame) -> DataFrame:
    """Rows of a stream or table that the contract admits."""
    return stream.where(C.reject_reason([c for c in C.PREDICTORS if c in stream.columns]).isNull())


def once(stream: DataFrame, key: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each request id once within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if stream.isStreaming else stream.dropDuplicates([key])


def drift_by_batch(ref: DataFrame, numeric: list[str], categorical: list[str], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that reports each micro-batch against the frozen reference."""

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(drift.report(ref, batch, numeric, categorical), number)

    return run
