"""Streams against their batch forms."""

from foreopen.streaming import windows as W


def _stream(spark, data, tmp_path, files=1):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    return events, W.event_stream(spark, str(tmp_path / "in"), events.schema, files)


def test_hourly(spark, data, tmp_path):
    events, stream = _stream(spark, data, tmp_path)
    got = W.drain(W.hourly(stream), "hourly", "complete", str(tmp_path / "c"))
    key = lambda df: sorted((r["start"], r["event_type"], r["n"]) for r in df.collect())
    assert key(got) == key(W.hourly(events))


def test_dedup(spark, data, tmp_path):
    events, stream = _stream(spark, data, tmp_path, files=10)  # in one batch: none is late
    twice = stream.union(stream)
    got = W.drain(W.deduplicated(twice, ("event_id",)), "dedup", "append", str(tmp_path / "c"))
    assert got.count() == events.count()


def test_target_windows(spark, data, tmp_path):
    from foreopen.sources.market import Market

    events, stream = _stream(spark, data, tmp_path)
    cal = Market(spark, data).calendar
    got = W.drain(W.by_target(stream, cal), "by_target", "complete", str(tmp_path / "c"))
    key = lambda df: sorted((r["target"], r["event_type"], r["n"]) for r in df.collect())
    assert key(got) == key(W.by_target(events, cal))


def _files(spark, tmp_path, batches, schema):
    """One file a batch, in order."""
    import time

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1 if k < len(batches) - 1 else 0)  # files are read in order of their times
    return W.event_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)


SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def _at(h, m=0):
    import datetime as dt

    return dt.datetime(2024, 1, 1, h, m)


def test_late_rows_are_dropped(spark, tmp_path):
    """A row older than the watermark that the batch before knew changes nothing; one within it counts."""
    batches = [[(1, _at(10), 1, "view", 1.0)], [(2, _at(14), 1, "view", 1.0)], [(7, _at(14, 30), 1, "view", 1.0)], [(3, _at(10, 30), 1, "view", 1.0), (4, _at(13), 1, "view", 1.0), (5, _at(20), 1, "view", 1.0)], [(6, _at(23), 1, "view", 1.0)]]
    stream = _files(spark, tmp_path, batches, SCHEMA)
    got = W.drain(W.hourly(stream), "late", "append", str(tmp_path / "c"))
    assert {r["start"].hour: r["n"] for r in got.collect()} == {10: 1, 13: 1, 14: 2, 20: 1}


def test_sliding(spark, data, tmp_path):
    events, stream = _stream(spark, data, tmp_path)
    got = W.drain(W.hourly(stream, "30 minutes"), "sliding", "complete", str(tmp_path / "c"))
    key = lambda df: sorted((r["start"], r["event_type"], r["n"]) for r in df.collect())
    assert key(got) == key(W.hourly(events, "30 minutes"))


def test_sessions(spark, tmp_path):
    """Runs closed by the watermark, one of them over two batches."""
    batches = [[(1, _at(10), 1, "view", 1.0), (2, _at(10, 5), 2, "view", 1.0)], [(3, _at(10, 20), 1, "view", 1.0), (4, _at(11, 30), 1, "view", 1.0)], [(5, _at(20), 9, "view", 1.0)], [(6, _at(23), 9, "view", 1.0)]]
    stream = _files(spark, tmp_path, batches, SCHEMA)
    got = W.drain(W.sessions(stream), "sessions", "append", str(tmp_path / "c"))
    assert sorted((r["user_id"], r["start"], r["n"]) for r in got.where("user_id < 9").collect()) == [(1, _at(10), 2), (1, _at(11, 30), 1), (2, _at(10, 5), 1)]


def test_first_stories(spark, tmp_path):
    """Windows in order over three batches, against the batch form."""
    from foreopen.operators.features import first_clusters

    told = [[("A", "x", 0), ("A", "y", 0), ("B", "x", 1)], [("A", "x", 4), ("A", "y", 6), ("B", "x", 2)], [("A", "x", 10), ("A", "x", 11), ("B", "x", 7)]]
    stream = _files(spark, tmp_path, told, "symbol string, ckey string, widx long")
    got = W.drain(W.first_stories(stream), "stories", "append", str(tmp_path / "c"))
    rows = spark.createDataFrame([(*t, 0, 1, None) for b in told for t in b], "symbol string, ckey string, widx long, is_template int, rel int, target date")
    key = lambda df: sorted((r["symbol"], r["ckey"], r["widx"], r["is_first"]) for r in df.collect())
    assert key(got) == key(first_clusters(rows))
