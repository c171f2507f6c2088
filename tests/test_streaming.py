import datetime as dt

from meshwind.streaming import incremental


def test_event_panel_and_follow(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=20 * k), "click" if k % 2 else "view", float(k)) for k in range(30)]
    source = str(tmp_path / "events")
    events = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    events.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    made = lambda df: df.groupBy("date").agg({"value": "avg"}).withColumnRenamed("avg(value)", "mean")
    q = incremental.follow(incremental.event_panel(stream), str(tmp_path / "panel"), str(tmp_path / "features"), made, 5, str(tmp_path / "checkpoint"))
    q.processAllAvailable()
    q.stop()
    panel = spark.read.parquet(str(tmp_path / "panel"))
    hours = {r.date for r in panel.collect()}
    assert start in {h.replace(tzinfo=None) for h in hours} and len(hours) >= 6
    assert spark.read.parquet(str(tmp_path / "features")).count() == len(hours)
