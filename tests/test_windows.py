"""Windowed counts hold every event of a finished table."""

from datetime import datetime, timedelta

from marginalia.plans import catalogue
from marginalia.streaming import progress

from .test_whole_jobs import equal


def test_stream_windows(spark, duck):
    assert "stream_windows" in catalogue.oracle_sql()
    assert equal(spark, duck, "stream_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")


def test_late_events_of_a_table_count(spark, tmp_path):
    names = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for hour in (20, 3, 9):  # a trigger for each file, later hours first
        at = datetime(2024, 1, 1, hour)
        spark.createDataFrame([(hour, at, 1, "view", 1.0, None), (hour + 100, at + timedelta(minutes=59), 1, "view", 2.0, None)], names).coalesce(1).write.parquet(f"{tmp_path}/{hour}")
        part = next(tmp_path.glob(f"{hour}/*.parquet"))
        part.rename(tmp_path / f"{30 - hour}.parquet")
    stream = progress.event_stream(spark, str(tmp_path), "*.parquet", 1)
    found = progress.run_to_end(progress.windowed(stream, late=None), "late_events")
    assert sorted((r.w.start.hour, r.n, r.total) for r in found.collect()) == [(3, 2, 3.0), (9, 2, 3.0), (20, 2, 3.0)]
