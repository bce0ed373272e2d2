"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foreopen.sources.market import Market, duck_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Digits that figures are compared at; FINE where a value may end in a 5 just after them.
DIGITS, FINE = 7, 9


def query(sql: str | None = None):
    """Register a function of a Market under its own name, with the DuckDB SQL that states its result."""

    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Market(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = duck_sql(sql)
        return f

    return keep


def rnd(c, digits: int = DIGITS) -> Column:
    """Rounded, and never minus zero: sums in another order differ in their last digits."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def r(sql: str, digits: int = DIGITS) -> str:
    return f"(round(cast({sql} as double), {digits}) + 0.0)"


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """All doubles rounded."""
    return df.select(*[rnd(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def score_ctes(src: str, keys: str, name: str = "scored") -> str:
    """CTEs that score the counts ``(keys, y, q, o)`` of src, into ``name`` (keys, n, score)."""
    k = f"{keys}, " if keys else ""
    on = " and ".join(f"a.{x.strip()} = b.{x.strip()}" for x in keys.split(",")) if keys else "true"
    ak = ", ".join(f"a.{x.strip()}" for x in keys.split(",")) + ", " if keys else ""
    group = f"group by {keys}" if keys else ""
    return f"""{name}_c as (select {k}y, q, sum(o)::double as o from {src} group by {k}y, q),
{name}_r as (select {k}y, sum(o) as rsum from {name}_c group by {k}y), {name}_k as (select {k}q, sum(o) as ksum from {name}_c group by {k}q),
{name}_n as (select {k}sum(o) as n, sum((y - q) * (y - q) * (y - 2) * (y - 2) * o) as num from {name}_c {group}),
{name}_e as (select {ak}sum((a.y - b.q) * (a.y - b.q) * (a.y - 2) * (a.y - 2) * a.rsum * b.ksum) as e from {name}_r a join {name}_k b on {on} {'group by ' + ak.rstrip(', ') if keys else ''}),
{name} as (select {ak}a.n::bigint as n, 1 - a.num / nullif(b.e / a.n, 0) as score from {name}_n a join {name}_e b on {on})"""
