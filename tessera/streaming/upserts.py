"""A stream of document batches into an index, and counts of what arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.indexes import Indexes


def stream_into(indexes: Indexes, name: str, batches: DataFrame, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch is one add_documents; a batch that is run again after a failure gives the same documents."""
    writer = batches.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: indexes.add_documents(name, batch, token=f"{checkpoint}:{number}") and None)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def arrivals(events: DataFrame, *, time: str = "ts", by: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, by, n, value): counts and sums by window, for streams and tables alike."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    grouped = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), by, "n", "value")
