"""An extension: request logs as a stream, counted by hour and operation.

Records later than the watermark are left out, as a batch run over the same logs shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.request_logs import parsed


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """New log files of a folder, as parsed records."""
    return parsed(spark.readStream.text(path)).filter("fault is null")


def hourly(records: DataFrame, late: str = "1 hour") -> DataFrame:
    """hour, operation, requests, failures, e2e_ms; works on streams and tables."""
    own = records.withWatermark("started_at", late) if records.isStreaming else records
    by = own.groupBy(F.window("started_at", "1 hour").alias("w"), "operation")
    out = by.agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status_code") >= 500).alias("failures"), F.sum("e2e_ms").alias("e2e_ms"))
    return out.select(F.col("w.start").alias("hour"), "operation", "requests", "failures", "e2e_ms")
