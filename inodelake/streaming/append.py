"""Append logs as a stream: the batch fold of ``operators.content``, kept up to date (beyond what a block image offers)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log_sizes(lines: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Lines and bytes that each file grew by, per window of ``ts``; lines later than ``late`` are dropped.

    ``lines`` is a stream of (file_id, ts, line). A line without a line break at its end gets one.
    """
    line = F.coalesce(F.col("line"), F.lit(""))
    size = F.octet_length(line) + F.when(F.endswith(line, F.lit("\n")), 0).otherwise(1)
    grouped = lines.withWatermark("ts", late).groupBy("file_id", F.window("ts", window).alias("during"))
    return grouped.agg(F.count(F.lit(1)).alias("lines"), F.sum(size).alias("bytes")).select("file_id", F.col("during.start").alias("start"), "lines", "bytes")
