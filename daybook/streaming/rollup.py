"""Event-time roll-ups on streams, with the same buckets as the batch operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup_stream(events: DataFrame, keys: Sequence[str], sums: Sequence[str], time: str = "ts", bucket: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Sums by key and window; state goes once the watermark, ``late`` behind the newest event, passes a window."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, bucket), *keys)
    rows = grouped.agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias("n_rows"))
    return rows.select(*keys, F.col("window.start").alias("bucket"), *sums, "n_rows")
