"""An incremental profile of a stream: window by window, late rows up to the watermark included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_profile(stream: DataFrame, time: str, value: str, by: str | None = None, width: str = "10 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """start, (by,) n, n_null, mean, std, min, max of each window; works on streams and on tables."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    windowed = stream.withWatermark(time, late) if stream.isStreaming else stream
    keys = [F.window(time, width, slide) if slide else F.window(time, width)] + ([F.col(by)] if by else [])
    x = F.col(value)
    out = windowed.groupBy(*keys).agg(
        F.count(x).alias("n"), F.count_if(x.isNull()).alias("n_null"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")
    )
    return out.select(F.col("window.start").alias("start"), *([by] if by else []), "n", "n_null", "mean", "std", "min", "max")
