"""Incremental forms of the event queries, on Structured Streaming.

Each function takes a streaming (or batch) DataFrame with event time ``ts`` and returns one of the same kind, so that a
batch run states the result that a finished stream must have.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foreopen.operators.asof import to_target


def event_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, some a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def timed(events: DataFrame, late: str = "2 hours") -> DataFrame:
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", late) if events.isStreaming else out


def hourly(events: DataFrame, slide: str | None = None) -> DataFrame:
    """Events and their value by type and hour, tumbling or sliding."""
    w = F.window("ts", "1 hour", slide) if slide else F.window("ts", "1 hour")
    return timed(events).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Each user's runs of events less than the gap apart."""
    got = timed(events).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return got.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: tuple[str, ...] = ("user_id", "event_type", "ts")) -> DataFrame:
    """The first of events with equal keys, remembered as long as the watermark allows."""
    out = timed(events)
    return out.dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else out.dropDuplicates(list(keys))


def by_target(events: DataFrame, calendar: DataFrame) -> DataFrame:
    """Events a target day: windows of irregular length come from a static calendar, not from window()."""
    plain = events.withColumn("known_at", F.col("ts").cast("timestamp_ntz"))
    return to_target(plain, calendar).groupBy("target", "event_type").agg(F.count("*").alias("n"))


STORY = "symbol string, ckey string, widx bigint, is_first boolean"


def first_stories(stories: DataFrame, lookback: int = 5) -> DataFrame:
    """``symbol, ckey, widx, is_first`` of a stream ``(symbol, ckey, widx)``: new unless told in the windows before.

    One number a story is remembered: the last window it was told in. Windows arrive in order; a batch may hold many,
    and repeated tellings within one window are one story. Several tellings of a window in two batches come out twice,
    the second one as not first.
    """

    def tell(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        told = sorted({int(w) for pdf in batches for w in pdf["widx"]})
        first = []
        for w in told:
            first.append(last is None or w - last > lookback)
            last = w if last is None else max(last, w)
        state.update((last,))
        yield pd.DataFrame({"symbol": key[0], "ckey": key[1], "widx": told, "is_first": first})

    return stories.groupBy("symbol", "ckey").applyInPandasWithState(tell, STORY, "last bigint", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what its source has now, into a table in memory (for tests and small results)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
