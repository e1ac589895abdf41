"""Streams give what batches give."""

from pyspark.sql import functions as F

from orrery.functions import timespan as ts
from orrery.streaming import ingest


def test_ingest_once_and_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    events.limit(300).write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(events.schema).parquet(source)
        ingest.ingest(stream, target, ["event_id"], str(tmp_path / "state")).awaitTermination()
        events.limit(300).write.mode("append").parquet(source)
    assert spark.read.parquet(target).count() == events.limit(300).select("event_id").distinct().count()


def test_calibrated_matches_batch(spark):
    events = spark.createDataFrame([(1, 5), (1, 15), (2, 5)], "k long, t long")
    cal = spark.createDataFrame([(1, "a", 0, 10), (1, "b", 10, 20)], "k long, c string, b long, e long").select("k", "c", ts.span(F.col("b"), F.col("e")).alias("validity"))
    assert sorted(r["c"] for r in ingest.calibrated(events, cal, ["k"], "t").collect()) == ["a", "b"]
