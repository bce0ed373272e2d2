"""The market tables and the point-in-time ways to read them.

Each table is a view over the driver's files, stated once in SQL that both Spark and DuckDB understand.
"""

from __future__ import annotations

import json
import re
import tomllib
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Views in order of need. @TS: a timestamp without zone; @DOW(d): Monday is 1; @E(n): n-th component of embedding.
VIEWS = {
    "v_bars0": """select concat('T', translate(lpad(cast(user_id % 20 as string), 2, '0'), '0123456789', 'ABCDEFGHIJ')) as symbol,
 event_id, ts, user_id, event_type, value, cast(ts as date) as d, hour(ts) as h from {events}""",
    "v_price": """select symbol, cast(d as @TS) + interval '1' hour * h as datetime, max_by(100 + value / 25, event_id) as close,
 case when h <= 9 then 'pre' when h < 16 then 'regular' else 'post' end as session, count(*) as volume,
 cast(d as @TS) + interval '1' minute * (case when h = 9 then 570 else 60 * (h + 1) end) as known_at
 from {v_bars0} where @DOW(d) <= 5 group by symbol, d, h""",
    "v_daily": """select *, close / prev_close - 1 as ret, cast(date_et as @TS) + interval '16' hour as known_at from (
 select *, lag(close) over (partition by symbol order by date_et) as prev_close from (
 select symbol, cast(datetime as date) as date_et, max(close) as high, min(close) as low, max_by(close, datetime) as close, count(*) as volume
 from {v_price} where session = 'regular' group by symbol, cast(datetime as date)) a) b""",
    "v_daily_long": """select *, close / prev_close - 1 as ret, cast(date_et as @TS) + interval '16' hour as known_at from (
 select *, lag(close) over (partition by symbol order by date_et) as prev_close from (
 select concat('L', translate(cast(o_custkey % 8 as string), '01234567', 'ABCDEFGH')) as symbol, cast(o_orderdate as date) as date_et,
 100 + max(o_totalprice) / 20000 as high, 100 + min(o_totalprice) / 20000 as low,
 max_by(100 + o_totalprice / 20000, o_orderkey) as close, count(*) as volume
 from {orders} group by o_custkey % 8, cast(o_orderdate as date)) a) b""",
    "v_news": """select doc_id, cast('2024-01-01' as @TS) + interval '1' minute * ((n_chars * 2617) % 43200 + doc_id % 600) as known_at,
 concat('T', translate(lpad(cast(n_chars % 20 as string), 2, '0'), '0123456789', 'ABCDEFGHIJ'),
 case when doc_id % 3 = 0 then concat(',T', translate(lpad(cast((n_chars * 7 + 3) % 20 as string), 2, '0'), '0123456789', 'ABCDEFGHIJ')) else '' end) as symbols,
 source, substr(split_part(text, chr(10), 1), 1, 120) as title, cast((doc_id * 37) % 201 as double) / 10 - 10 as tone, lang from {documents}""",
    "v_reddit": """select conv_id, turn, concat('sub', cast(conv_id % 8 as string)) as sub, case when turn = 0 then 'posts' else 'comments' end as kind,
 cast('2024-01-01' as @TS) + interval '1' minute * ((conv_id * 7919 + turn * 37) % 43200) as created_et,
 concat(case when conv_id % 4 = 0 then '$' else '' end, case when conv_id % 2 = 0 then concat('T', translate(lpad(cast(conv_id % 20 as string), 2, '0'), '0123456789', 'ABCDEFGHIJ'), ' ') else '' end, text) as body
 from {conversations}""",
    "v_earnings": """select symbol, ts as known_at, event_id, eps_reported, eps_estimate, (eps_reported / nullif(eps_estimate, 0) - 1) * 100 as surprise_pct from (
 select symbol, ts, event_id, value / 20 as eps_reported, lag(value) over (partition by symbol order by ts, event_id) / 20 as eps_estimate
 from {v_bars0} where event_type = 'purchase') a""",
    "v_analyst": """select symbol, ts as known_at, case event_type when 'signup' then 'up' when 'error' then 'down' else 'init' end as action,
 value as target_current, lag(value) over (partition by symbol order by ts, event_id) as target_prior
 from {v_bars0} where event_type in ('signup', 'error', 'view')""",
    "v_pred": """select symbol, event_id, d as target, draw, fold, seen, s,
 case when r < -2.5 then 0 when r < -0.6 then 1 when r < 0.6 then 2 when r < 2.5 then 3 else 4 end as label,
 case when s < -2.5 then 0 when s < -0.6 then 1 when s < 0.6 then 2 when s < 2.5 then 3 else 4 end as pred
 from (select symbol, event_id, d, user_id % 3 as draw, case when d < cast('2024-01-11' as date) then 'A' when d < cast('2024-01-21' as date) then 'B' else 'C' end as fold,
 user_id % 20 < 10 as seen, (value - 45) / 15 as r, (value - 45) / 15 + cast((event_id * 7919) % 100 - 50 as double) / 25 as s from {v_bars0}) a""",
    "v_finbert": """select vec_id, cast(vec_id as string) as title_id, embedding, label, exp(@E(1)) / z as p_pos, exp(@E(2)) / z as p_neg, exp(@E(3)) / z as p_neu
 from (select *, exp(@E(1)) + exp(@E(2)) + exp(@E(3)) as z from {embeddings}) a""",
    "v_calendar": """select date_et as date, lead(date_et) over (order by date_et) as target from (select distinct date_et from {v_daily}) a""",
}
_DUCK_CALENDAR = {"@TS": "timestamp", "@DOW": "isodow"}


def _dialect(sql: str, duck: bool) -> str:
    sql = sql.replace("@TS", "timestamp" if duck else "timestamp_ntz")
    sql = sql.replace("@DOW(d)", "isodow(d)" if duck else "(weekday(d) + 1)")
    return re.sub(r"@E\((\d)\)", r"embedding[\1]" if duck else r"element_at(embedding, \1)", sql)


def needs(sql: str) -> list[str]:
    """The views a text names, each after the views it is made of."""
    out: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            out += [x for x in (*needs(VIEWS[name]), name) if x not in out]
    return out


def duck_sql(sql: str) -> str:
    """A DuckDB query over the views it names, as one text over the driver's tables."""
    views = [f"{v} as ({re.sub(r'[{}]', '', _dialect(VIEWS[v], True))})" for v in sorted(needs(sql), key=list(VIEWS).index)]
    body = sql.strip()
    recursive = body.lower().startswith("with recursive")
    body = re.sub(r"(?i)^with (recursive )?", "", body)
    if body == sql.strip():
        return f"with {', '.join(views)} {body}" if views else body
    return f"with {'recursive ' * recursive}{', '.join([*views, body])}"


class Market:
    """The tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.raw(name)
        sql = _dialect(VIEWS[name], False)
        return self.spark.sql(sql, **{x: self.view(x) for x in re.findall(r"\{(\w+)\}", sql)})

    price = cached_property(lambda self: self.view("v_price"))
    daily = cached_property(lambda self: self.view("v_daily"))
    daily_long = cached_property(lambda self: self.view("v_daily_long"))
    news = cached_property(lambda self: self.view("v_news"))
    reddit = cached_property(lambda self: self.view("v_reddit"))
    earnings = cached_property(lambda self: self.view("v_earnings"))
    analyst = cached_property(lambda self: self.view("v_analyst"))
    predictions = cached_property(lambda self: self.view("v_pred"))
    finbert = cached_property(lambda self: self.view("v_finbert"))
    calendar = cached_property(lambda self: calendar_of(self.view("v_daily").select("date_et")))


def calendar_of(dates: DataFrame) -> DataFrame:
    """``(date, target)``: every trading day and the next one, null for the last. Days are few: one small window."""
    day = dates.columns[0]
    return dates.select(F.col(day).alias("date")).distinct().withColumn("target", F.lead("date").over(Window.orderBy("date")))


def cutoff(day: Column) -> Column:
    """When a target day's information ends: its 09:30, the moment itself excluded."""
    return day.cast("timestamp_ntz") + F.expr("interval '09:30' hour to minute")


def as_of(table: DataFrame, until, since=None, symbols: list[str] | None = None, columns: list[str] | None = None, known: str = "known_at") -> DataFrame:
    """Rows with since <= known_at < until, of the symbols named; a comma list counts if it has any of them.

    A plain filter and projection, so both reach the file scan.
    """
    out = table.where(F.col(known) < until)
    if since is not None:
        out = out.where(F.col(known) >= since)
    if symbols is not None:
        symbols = [symbols] if isinstance(symbols, str) else list(symbols)
        out = tagged(out, symbols) if "symbols" in table.columns else out.where(F.col("symbol").isin(symbols))
    if columns is not None:
        key = "symbols" if "symbols" in table.columns else "symbol"
        out = out.select([c for c in dict.fromkeys([*columns, known, key]) if c in table.columns])
    return out


def tagged(table: DataFrame, symbols: list[str]) -> DataFrame:
    """Rows whose comma list of symbols has any of those wanted."""
    return table.where(F.arrays_overlap(F.split(F.coalesce("symbols", F.lit("")), ","), F.array(*map(F.lit, symbols))))


def start_of(calendar: DataFrame, days: int | None = None, hours: int | None = None, since=None) -> DataFrame:
    """The calendar with the start of each day's window: since, else hours before the cutoff, else the days-th last day."""
    if since is not None:
        return calendar.withColumn("start", F.lit(since).cast("timestamp_ntz"))
    if hours is not None:
        return calendar.withColumn("start", cutoff(F.col("target")) - F.expr(f"interval '{int(hours)}' hour"))
    order = Window.orderBy("date")
    first = F.first("date").over(order.rowsBetween(-(int(days or 1) - 1), 0))
    return calendar.withColumn("start", first.cast("timestamp_ntz"))


def label_of(pct: Column) -> Column:
    """Five ordered classes of a return in percent, cut at -2.5, -0.6, 0.6 and 2.5, each cut in the upper class."""
    return F.when(pct < -2.5, 0).when(pct < -0.6, 1).when(pct < 0.6, 2).when(pct < 2.5, 3).when(pct.isNotNull(), 4)


def labels(daily: DataFrame, since=None, until=None) -> DataFrame:
    """``(symbol, date, ret_pct, label)`` of days with a return."""
    out = daily.where("ret is not null").select("symbol", F.col("date_et").alias("date"), (F.col("ret") * 100).alias("ret_pct"))
    if since is not None:
        out = out.where(F.col("date") >= since)
    if until is not None:
        out = out.where(F.col("date") < until)
    return out.withColumn("label", label_of(F.col("ret_pct")))


def base_days(calendar: DataFrame, since: str = "2024-08-13") -> DataFrame:
    """Base dates from since on that have a next day."""
    return calendar.where((F.col("date") >= F.lit(since).cast("date")) & F.col("target").isNotNull())


def split_on(days: DataFrame, on: str) -> DataFrame:
    """Days marked train (target before ``on``) or test."""
    return days.withColumn("part", F.when(F.col("target") < F.lit(on).cast("date"), "train").otherwise("test"))


def reddit_rows(reddit: DataFrame, until, since=None, sub: str | None = None, kind: str = "both") -> DataFrame:
    """Posts, comments or both, cut on created_et; score columns are never read. Partition columns are sub and kind."""
    if kind not in ("posts", "comments", "both"):
        raise ValueError(f"kind: {kind}")
    out = as_of(reddit, until, since, known="created_et")
    if sub is not None:
        out = out.where(F.col("sub") == sub)
    out = out if kind == "both" else out.where(F.col("kind") == kind)
    return out.drop(*[c for c in ("score", "n_comments", "num_comments_reported", "retrieved_2nd_on") if c in out.columns])


def symbols_from(path: str | None, text: str | None = None) -> list[str]:
    """Symbols of a comma list, a JSON file (a list, or lists by name) or a text file of one a line."""
    if text:
        return [x.strip().upper() for x in text.split(",") if x.strip()]
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    if path.endswith(".json"):
        got = json.loads(raw)
        return list(dict.fromkeys(x for v in got.values() for x in v)) if isinstance(got, dict) else list(got)
    return [x.strip() for x in raw.splitlines() if x.strip()]


def names_from(path: str) -> dict[str, list[str]]:
    """Companies' names by ticker from a JSON object; a single name may stand alone, keys that begin with ``_`` are remarks."""
    with open(path, encoding="utf-8") as f:
        return {k: [v] if isinstance(v, str) else list(v) for k, v in json.load(f).items() if not k.startswith("_")}


def word_lists(spark: SparkSession, path: str) -> DataFrame:
    """``(word, kind)`` of a dictionary in CSV: a word is of a kind where its column is over 0; headers in any case."""
    got = spark.read.csv(path, header=True)
    names = {c.lower(): c for c in got.columns}
    kinds = [F.when(F.expr(f"try_cast(`{names[k]}` as double)") > 0, k) for k in ("positive", "negative", "uncertainty") if k in names]
    return got.select(F.upper(F.col(names["word"])).alias("word"), F.explode(F.array_compact(F.array(*kinds))).alias("kind")).distinct()


def load_toml(path: str) -> dict:
    with open(path, "rb") as f:
        return tomllib.load(f)


def write(df: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """Sinks: parquet, csv (with header), json (lines)."""
    writer = df.write.mode("overwrite").options(**({"header": True} if kind == "csv" else {}) | options)
    writer.format(kind).save(path)
