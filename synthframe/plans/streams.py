"""Queries over a stream of files, run to completion."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import cut
from ..streaming.profile import windowed_profile
from .registry import query, rounded, table


@query('select time_bucket(interval 1 hour, ts) as start, event_type, count(value) n, count(*) - count(value) n_null, round(avg(value), 6) mean, round(stddev_samp(value), 6) std, round(min(value), 6) as "min", round(max(value), 6) as "max" from events group by 1, 2')
def streaming_profile(spark, sf_dir):
    """The events table as a stream, profiled per hour and type; the sink holds one row per window and type."""
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    name = f"profile_{uuid.uuid4().hex}"
    job = windowed_profile(stream, "ts", "value", "event_type", "1 hour").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    job.awaitTermination()
    return rounded(cut(spark.table(name), "stream").withColumn("start", F.col("start").cast("timestamp_ntz")))
