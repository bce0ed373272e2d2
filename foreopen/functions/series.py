"""Ordered-series columns: rolling and recursive statistics that never look ahead."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def by(*keys: str, order: str | list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def rolling(x: Column, w: WindowSpec, n: int, least: int | None = None, agg: Callable[[Column], Column] = F.avg, skip: int = 0) -> Column:
    """An aggregate of the last n rows (``skip``: of n rows before the last ``skip``), null under ``least`` values."""
    frame = w.rowsBetween(-(n - 1) - skip, -skip)
    least = max(2, n // 2) if least is None else least
    return F.when(F.count(x).over(frame) >= least, agg(x).over(frame))


def wma(x: Column, w: WindowSpec, n: int) -> Column:
    """Weights n for the newest row down to 1; null before n values."""
    parts = [x * n if i == 0 else F.lag(x, i).over(w) * (n - i) for i in range(n)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total / (n * (n + 1) / 2)


def true_range(high: Column, low: Column, close: Column, w: WindowSpec) -> Column:
    before = F.lag(close).over(w)
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


def pct_rank(x: Column, *keys: str) -> Column:
    """Average rank of x within a group, as a share of the values that aren't null; null for null."""
    own = Window.partitionBy(*keys)
    rank = F.rank().over(own.orderBy(x.asc_nulls_last()))
    ties = F.count("*").over(Window.partitionBy(*keys, x))
    return F.when(x.isNotNull(), (rank + (ties - 1) / 2.0) / F.count(x).over(own))


def loo_median(df: DataFrame, out: str, x: Column, *keys: str, least: int = 3, order: str = "symbol") -> DataFrame:
    """df with the median of each group's other values; null under ``least`` others.

    A row without a value gets the median of all. Whichever value is left out, the median lies among three neighbouring
    places of the sorted group; only those three are attached to its rows. Equal values may come in any order.
    """
    group = Window.partitionBy(*keys)
    df = df.withColumn("_x", x)
    df = df.withColumns({"_n": F.count("_x").over(group), "_p": F.row_number().over(group.orderBy(F.col("_x").asc_nulls_last(), order)) - 1})
    first = F.greatest(F.floor((F.col("_n") - 2) / 2), F.lit(0))
    at = [F.max(F.when(F.col("_p") == first + i, F.col("_x"))).over(group) for i in range(3)]
    df = df.withColumns({f"_v{i}": c for i, c in enumerate(at)})
    others = F.col("_n") - F.when(F.col("_x").isNotNull(), 1).otherwise(0)

    def other(i: Column) -> Column:  # the i-th of the others
        place = (i + F.when(F.col("_x").isNotNull() & (i >= F.col("_p")), 1).otherwise(0) - first).cast("int")
        return F.when(place == 0, F.col("_v0")).when(place == 1, F.col("_v1")).when(place == 2, F.col("_v2"))

    middle = (other(F.floor((others - 1) / 2)) + other(F.floor(others / 2))) / 2
    return df.withColumn(out, F.when(others >= least, middle)).drop("_x", "_n", "_p", "_v0", "_v1", "_v2")


def clip(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def recursion(x: np.ndarray, alpha: float, start: float, block: int = 256) -> np.ndarray:
    """s = alpha * x + (1 - alpha) * s from a start value, in blocks of one matrix product each."""
    lag = np.arange(block)[:, None] - np.arange(block)[None, :]
    kernel = np.where(lag >= 0, alpha * (1 - alpha) ** np.maximum(lag, 0), 0.0)
    fade = (1 - alpha) ** np.arange(1, block + 1)
    out = np.empty(len(x))
    for at in range(0, len(x), block):
        part = x[at : at + block]
        out[at : at + block] = kernel[: len(part), : len(part)] @ part + fade[: len(part)] * start
        start = out[at + len(part) - 1]
    return out


def smooth(df: DataFrame, key: str, order: str, value: str, out: str, alpha: float, seed_at: int = 0, seed: str = "value") -> DataFrame:
    """Recursive smoothing s = a * x + (1 - a) * s along each key, as a column of df.

    It begins at the series' ``seed_at``-th value with that value, or (seed "mean") with the mean of the ``seed_at``
    values up to it, the first left out; rows before are null. Null values are skipped and get null. The series of one
    key is one ordered pass; each row comes back once, with all of its columns. Rows of equal order keep any order.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        own = table[value].cast(pa.float64()).to_numpy(zero_copy_only=False)
        there = np.flatnonzero(~np.isnan(own))
        x, s = own[there], np.full(len(there), np.nan)
        if len(x) > seed_at:
            s[seed_at] = x[1 : seed_at + 1].mean() if seed == "mean" else x[seed_at]
            s[seed_at + 1 :] = recursion(x[seed_at + 1 :], alpha, s[seed_at])
        whole = np.full(len(own), np.nan)
        whole[there] = s
        return table.append_column(out, pa.array(whole, pa.float64(), from_pandas=True))

    df = df.drop(out)
    schema = StructType([*df.schema.fields, StructField(out, DoubleType())])
    return df.groupBy(key).applyInArrow(run, schema)


def span_to_alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def alpha_to_span(alpha: float) -> float:
    return 2.0 / alpha - 1.0


def center_of_mass(alpha: float) -> float:
    """Mean age of a smoothed value's weights."""
    return (1.0 - alpha) / alpha


def weight_profile(alpha: float, n: int) -> list[float]:
    """Weights of the last n values, the newest first."""
    return [alpha * (1.0 - alpha) ** i for i in range(n)]
