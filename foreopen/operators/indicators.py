"""Technical indicators along each symbol's days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreopen.functions import series as S

KEY, DAY = "symbol", "date_et"


def _w():
    return S.by(KEY, order=DAY)


def macd(daily: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Difference of two smoothed closes, its own smoothing and their difference, each over the close."""
    x = daily.select(KEY, DAY, "close")
    for name, span in (("_fast", fast), ("_slow", slow)):
        x = S.smooth(x, KEY, DAY, "close", name, S.span_to_alpha(span))
    x = S.smooth(x.withColumn("_d", F.col("_fast") - F.col("_slow")), KEY, DAY, "_d", "_s", S.span_to_alpha(signal))
    return x.select(KEY, DAY, (F.col("_d") / F.col("close")).alias("macd"), (F.col("_s") / F.col("close")).alias("signal"), ((F.col("_d") - F.col("_s")) / F.col("close")).alias("hist"))


def rsi(daily: DataFrame, n: int = 14) -> DataFrame:
    """Relative strength: rises and falls begin as means of n changes, then are smoothed by 1/n; 100 without falls."""
    change = F.col("close") - F.lag("close").over(_w())
    part = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    x = daily.select(KEY, DAY, part(change).alias("_up"), part(-change).alias("_down"))
    x = S.smooth(x, KEY, DAY, "_up", "_u", 1 / n, n, "mean")
    x = S.smooth(x, KEY, DAY, "_down", "_v", 1 / n, n, "mean")
    value = F.when(F.col("_u").isNull(), None).when(F.col("_v") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(F.col("_u"), F.col("_v"))))
    return x.select(KEY, DAY, value.alias("rsi"))


def true_range(daily: DataFrame) -> DataFrame:
    return daily.withColumn("tr", S.true_range(F.col("high"), F.col("low"), F.col("close"), _w()))


def atr(daily: DataFrame, n: int = 14) -> DataFrame:
    """True range smoothed by 1/n, from the mean of the n after the first."""
    return S.smooth(true_range(daily).select(KEY, DAY, "tr"), KEY, DAY, "tr", "atr", 1 / n, n, "mean")


def bollinger(daily: DataFrame, n: int = 20, k: float = 2.0, ddof: int = 0) -> DataFrame:
    mid = S.rolling(F.col("close"), _w(), n, least=n)
    sd = S.rolling(F.col("close"), _w(), n, least=n, agg=F.stddev_samp if ddof else F.stddev_pop)
    x = daily.select(KEY, DAY, "close", mid.alias("mid"), (sd * k).alias("_band"))
    return x.select(KEY, DAY, "mid", (F.col("mid") + F.col("_band")).alias("upper"), (F.col("mid") - F.col("_band")).alias("lower"), F.try_divide(F.col("close") - F.col("mid") + F.col("_band"), 2 * F.col("_band")).alias("pct_b"), (2 * F.col("_band") / F.col("mid")).alias("width"))


def golden_cross(daily: DataFrame, fast: int = 50, slow: int = 200) -> DataFrame:
    """1 where the fast mean rises over the slow one, -1 where it falls under it, else 0."""
    d = S.rolling(F.col("close"), _w(), fast, least=fast) - S.rolling(F.col("close"), _w(), slow, least=slow)
    x = daily.select(KEY, DAY, d.alias("_d")).withColumn("_p", F.lag("_d").over(_w()))
    return x.select(KEY, DAY, F.when((F.col("_d") > 0) & (F.col("_p") < 0), 1).when((F.col("_d") < 0) & (F.col("_p") > 0), -1).otherwise(0).alias("cross"))


def pre_market_return(price: DataFrame) -> DataFrame:
    """Last over first pre-market close of a day, with two bars at least."""
    g = price.where("session = 'pre'").groupBy(KEY, F.col("datetime").cast("date").alias("day"))
    x = g.agg(F.count("*").alias("n"), F.max_by("close", "datetime").alias("l"), F.min_by("close", "datetime").alias("f"))
    return x.select(KEY, "day", F.when(F.col("n") >= 2, F.col("l") / F.col("f") - 1).alias("pre_ret"))


def sample_features(daily: DataFrame, price: DataFrame | None = None, least: int = 30) -> DataFrame:
    """``ret1, ret5, rsi14, macd_hist, pct_b, band_width, vol_ratio`` (and ``pre_ret``) from each symbol's ``least``-th day on."""
    w = _w()
    volume = F.col("volume").cast("double")
    x = daily.select(
        KEY, DAY, F.row_number().over(w).alias("_n"), (F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).alias("ret1"), (F.try_divide(F.col("close"), F.lag("close", 5).over(w)) - 1).alias("ret5"),
        F.try_divide(volume, S.rolling(volume, w, 20, least=1)).alias("vol_ratio"),
    )
    parts = [rsi(daily).withColumnRenamed("rsi", "rsi14"), macd(daily).select(KEY, DAY, F.col("hist").alias("macd_hist")), bollinger(daily).select(KEY, DAY, "pct_b", F.col("width").alias("band_width"))]
    for p in parts:
        x = x.join(p, [KEY, DAY], "left")
    if price is not None:
        x = x.join(pre_market_return(price).withColumnRenamed("day", DAY), [KEY, DAY], "left")
    return x.where(F.col("_n") >= least).drop("_n")
