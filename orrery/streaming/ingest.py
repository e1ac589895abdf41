"""Streams, an extension of the catalogue: incremental ingest and calibration lookup of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from orrery.functions import timespan as ts


def ingest(stream: DataFrame, target: str, keys: Sequence[str], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends to the Parquet table ``target`` the rows of a stream whose keys it doesn't hold yet.

    A batch is written under its number, so that one that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(list(keys))
        try:
            held = batch.sparkSession.read.parquet(target).where(F.col("_batch") < number).select(*keys)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # nothing has been written yet
                raise
        else:
            new = new.join(held, list(keys), "left_anti")
        new.write.mode("overwrite").parquet(f"{target}/_batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their summed values by tumbling window and key; later rows than the watermark are dropped."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    counted = timed.groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("begin"), key, "n", "total")


def calibrated(events: DataFrame, calibrations: DataFrame, keys: Sequence[str], at: str, validity: str = "validity") -> DataFrame:
    """A stream joined with the calibration of its key that is valid at its time (a stream-static join)."""
    return events.join(calibrations, list(keys)).where(ts.contains_time(F.col(validity), F.col(at)))
