"""The streamed feed gives what the batch gives."""

import datetime as dt

from tidegauge.streaming import feed


def test_day_counts_match_the_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1 + i % 3, 10), "view" if i % 2 else "click") for i in range(20)]
    spark.createDataFrame(rows, "event_id long, event_time timestamp_ntz, event_type string").write.parquet(str(tmp_path / "in"))
    stream = feed.read_events(spark, str(tmp_path / "in"), "event_id long, event_time timestamp_ntz, event_type string")
    q = feed.day_counts(stream).writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.n for r in spark.table("days").collect()) == 20 and spark.table("days").count() == 6


def test_released_gives_each_event_once_with_its_day(spark, tmp_path):
    at = dt.datetime
    rows = [(1, at(2024, 1, 1, 15)), (1, at(2024, 1, 1, 15)), (2, at(2024, 1, 1, 15, 0, 1)), (3, at(2024, 1, 2, 9))]
    spark.createDataFrame(rows, "event_id long, available_at timestamp_ntz").write.parquet(str(tmp_path / "in"))
    out = feed.released(feed.read_events(spark, str(tmp_path / "in"), "event_id long, available_at timestamp_ntz"))
    q = out.writeStream.format("memory").queryName("released").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.event_id, r.due) for r in spark.table("released").collect())
    assert got == [(1, dt.date(2024, 1, 1)), (2, dt.date(2024, 1, 2)), (3, dt.date(2024, 1, 2))]
