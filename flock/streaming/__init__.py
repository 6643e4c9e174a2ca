"""Streaming ingestion of engagement events.

The reference has no stream processing (SURVEY 2.9): every metric is a batch
query over finite tables.  What a continuous deployment needs is only the
*sink* side: check-ins and gifts arriving as a stream are appended to a
month-partitioned table, so the batch operators read them with partition
pruning.  That is a Structured Streaming file sink with exactly-once
semantics through its checkpoint (kept under ``spark.checkpoint.dir``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_bucket
from ..session import ensure_checkpoint_dir


def append_events(stream: DataFrame, path: str, ts_col: str, name: str, available_now: bool = True):
    """Append a streaming DataFrame of events to ``path`` partitioned by
    ``event_month`` (derived from ``ts_col``).  Returns the started query."""
    root = ensure_checkpoint_dir(stream.sparkSession)
    out = stream.withColumn("event_month", month_bucket(ts_col))
    writer = (out.writeStream.format("parquet").option("path", path)
              .option("checkpointLocation", f"{root.rstrip('/')}/stream-{name}")
              .partitionBy("event_month").outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_events(spark, path: str, since=None) -> DataFrame:
    """Batch read of an appended event table; a ``since`` month prunes partitions."""
    df = spark.read.parquet(path)
    return df.where(F.col("event_month") >= F.lit(str(since)).cast("date")) if since else df
