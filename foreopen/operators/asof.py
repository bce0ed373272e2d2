"""Mapping moments to target days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foreopen.sources.market import cutoff


def to_target(events: DataFrame, calendar: DataFrame, time: str = "known_at") -> DataFrame:
    """Adds ``target``: the day whose window, from the day before's 09:30 to its own 09:30 (excluded), has the moment.

    Rows outside any window go. Each calendar day of a window is one row, so this is an equality join on the day with a
    filter for the rest, not a comparison of all pairs.
    """
    days = _days(calendar.where("target is not null"))
    at = F.col(time)
    got = events.withColumn("_day", at.cast("date")).join(_few(days), "_day")
    return got.where((at >= F.col("_lo")) & (at < F.col("_hi"))).drop("_day", "_lo", "_hi")


def to_next_cutoff(events: DataFrame, targets: DataFrame, time: str = "known_at") -> DataFrame:
    """Adds ``target``: the first day of ``(target)`` whose cutoff is after the moment; none (null) after the last.

    Moments before the first cutoff have none either: what came before the first window is unknown.
    """
    order = Window.orderBy("target")
    days = targets.select("target").distinct().withColumn("date", F.lag("target").over(order)).where("date is not null")
    at = F.col(time)
    hit = to_target(events, days, time)
    first = days.agg(F.min("date").alias("a"), F.max("target").alias("b"))
    out = events.join(F.broadcast(first)).where((at < cutoff(F.col("a"))) | (at >= cutoff(F.col("b"))) | F.col("a").isNull())
    return hit.unionByName(out.drop("a", "b").withColumn("target", F.lit(None).cast("date")))


def _days(pairs: DataFrame) -> DataFrame:
    return pairs.select("target", F.explode(F.sequence(F.col("date"), F.col("target"))).alias("_day"), cutoff(F.col("date")).alias("_lo"), cutoff(F.col("target")).alias("_hi"))


def _few(days: DataFrame, most: int = 100_000) -> DataFrame:
    """The calendar's rows, broadcast where they are few, as they are unless it spans centuries."""
    return F.broadcast(days) if days.limit(most + 1).count() <= most else days
