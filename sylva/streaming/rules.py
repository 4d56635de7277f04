"""The same rules over a stream of file rows: stateless ones as they are, counts by directory as a running aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.paths import parent


def directory_counts(files: DataFrame) -> DataFrame:
    """A streaming table of files (path) as running counts by directory (output mode update or complete)."""
    return files.groupBy(parent(F.col("path")).alias("path")).agg(F.count("*").alias("n"))


def late_tolerant_counts(events: DataFrame, time: str, key: str, window: str, late: str) -> DataFrame:
    """Counts by key and window; rows later than `late` are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))
