"""Indicators on the long daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreopen.functions import series as S
from foreopen.operators import indicators as I
from foreopen.plans.registry import FINE, query, r, rounded

_W = "window w as (partition by symbol order by date_et)"


def _fold(x: str, alpha: float, seed_at: int = 0, mean: bool = False, src: str = "v_daily_long") -> str:
    """CTEs ``f``: the smoothed series (symbol, date_et, s) by a recursion over row numbers."""
    first = f"(select avg(x) from num m where m.symbol = n.symbol and m.i between 1 and {seed_at})" if mean else "n.x"
    return f"""num as (select symbol, date_et, x, row_number() over (partition by symbol order by date_et) - 1 as i from (select symbol, date_et, {x} as x from {src}) q where x is not null),
f as (select n.symbol, n.i, n.date_et, ({first})::double as s from num n where n.i = {seed_at}
 union all select n.symbol, n.i, n.date_et, {alpha!r} * n.x + {1 - alpha!r} * f.s from f join num n on n.symbol = f.symbol and n.i = f.i + 1)"""


@query(f"select symbol, date_et, {r('case when count(close) over v >= 20 then avg(close) over v end', FINE)} as sma from v_daily_long window v as (partition by symbol order by date_et rows between 19 preceding and current row)")
def sma(m):
    d = m.daily_long
    return rounded(d.select("symbol", "date_et", S.rolling(F.col("close"), S.by("symbol", order="date_et"), 20, least=20).alias("sma")), FINE)


@query(f"select symbol, date_et, {r('(' + ' + '.join(f'{10 - i} * lag(close, {i}) over w' for i in range(10)) + ') / 55')} as wma from v_daily_long {_W}")
def wma(m):
    return rounded(m.daily_long.select("symbol", "date_et", S.wma(F.col("close"), S.by("symbol", order="date_et"), 10).alias("wma")))


@query(f"with recursive {_fold('close', S.span_to_alpha(12))} select symbol, date_et, {r('s')} as ema from f")
def ema(m):
    return rounded(S.smooth(m.daily_long.select("symbol", "date_et", "close"), "symbol", "date_et", "close", "ema", S.span_to_alpha(12)).select("symbol", "date_et", "ema"))


@query(f"with recursive {_fold('close', 1 / 14, 13)} select v.symbol, v.date_et, {r('s')} as wilder from v_daily_long v left join f on f.symbol = v.symbol and f.date_et = v.date_et")
def ema_seeded(m):
    """Smoothing by 1/14 that begins at the fourteenth value; rows before are null."""
    return rounded(S.smooth(m.daily_long.select("symbol", "date_et", "close"), "symbol", "date_et", "close", "wilder", 1 / 14, seed_at=13).select("symbol", "date_et", "wilder"))


def _named(sql: str, suffix: str) -> str:
    return sql.replace("num as", f"num{suffix} as").replace("from num ", f"from num{suffix} ").replace("join num ", f"join num{suffix} ").replace("\nf as", f"\nf{suffix} as").replace("from f ", f"from f{suffix} f ")


_MACD = f"""{_named(_fold('close', S.span_to_alpha(12)), '1')}, {_named(_fold('close', S.span_to_alpha(26)), '2')},
d as (select f1.symbol, f1.date_et, f1.s - f2.s as macd from f1 join f2 on f1.symbol = f2.symbol and f1.date_et = f2.date_et),
{_named(_fold('macd', S.span_to_alpha(9), src='d'), '3')}"""


@query(f"""with recursive {_MACD} select d.symbol, d.date_et, {r('macd / close')} as macd, {r('s / close')} as signal, {r('(macd - s) / close')} as hist
 from d join f3 on f3.symbol = d.symbol and f3.date_et = d.date_et join v_daily_long v on v.symbol = d.symbol and v.date_et = d.date_et""")
def macd(m):
    return rounded(I.macd(m.daily_long).select("symbol", "date_et", "macd", "signal", "hist"))


_CHANGE = "(select symbol, date_et, close - lag(close) over (partition by symbol order by date_et) as ch from v_daily_long)"
_RSI_SEED = lambda x, k: _named(_fold(x, 1 / 14, 14, True, src="chg"), k)


@query(f"""with recursive chg as (select symbol, date_et, greatest(coalesce(ch, 0), 0) as up, greatest(coalesce(-ch, 0), 0) as dn from {_CHANGE} a),
{_RSI_SEED('up', '1')}, {_RSI_SEED('dn', '2')}
select v.symbol, v.date_et, {r('case when f1.s is null then null when f2.s = 0 then 100.0 else 100 - 100 / (1 + f1.s / f2.s) end')} as rsi from v_daily_long v
 left join f1 on f1.symbol = v.symbol and f1.date_et = v.date_et left join f2 on f2.symbol = v.symbol and f2.date_et = v.date_et""")
def rsi(m):
    return rounded(I.rsi(m.daily_long).select("symbol", "date_et", "rsi"))


_TR = "greatest(high - low, abs(high - lag(close) over (partition by symbol order by date_et)), abs(low - lag(close) over (partition by symbol order by date_et)))"


@query(f"select symbol, date_et, {r(_TR)} as tr from v_daily_long")
def true_range(m):
    return rounded(I.true_range(m.daily_long).select("symbol", "date_et", "tr"))


@query(f"""with recursive t as (select symbol, date_et, {_TR} as tr from v_daily_long), {_fold('tr', 1 / 14, 14, True, src='t')}
 select v.symbol, v.date_et, {r('s')} as atr from v_daily_long v left join f on f.symbol = v.symbol and f.date_et = v.date_et""")
def atr_wilder(m):
    return rounded(I.atr(m.daily_long).select("symbol", "date_et", "atr"))


@query(f"""with t as (select symbol, date_et, {_TR} / close as tr from v_daily_long) select symbol, date_et, {r('avg(tr) over (partition by symbol order by date_et rows between 13 preceding and current row)')} as atr_share from t""")
def atr_share(m):
    t = I.true_range(m.daily_long).withColumn("t", F.col("tr") / F.col("close"))
    return rounded(t.select("symbol", "date_et", S.rolling(F.col("t"), S.by("symbol", order="date_et"), 14, least=1).alias("atr_share")))


_BB = "case when count(close) over v >= 20 then {} end"


@query(f"""with b as (select symbol, date_et, close, {_BB.format('avg(close) over v')} as mid, {_BB.format('stddev_pop(close) over v')} as sd
 from v_daily_long window v as (partition by symbol order by date_et rows between 19 preceding and current row))
 select symbol, date_et, {r('mid', FINE)} as mid, {r('mid + 2 * sd', FINE)} as upper, {r('mid - 2 * sd', FINE)} as lower, {r('(close - (mid - 2 * sd)) / nullif(4 * sd, 0)', FINE)} as pct_b, {r('4 * sd / mid', FINE)} as width from b""")
def bollinger(m):
    return rounded(I.bollinger(m.daily_long).select("symbol", "date_et", "mid", "upper", "lower", "pct_b", "width"), FINE)


@query("""with a as (select symbol, date_et, case when count(close) over v50 >= 50 then avg(close) over v50 end - case when count(close) over v200 >= 200 then avg(close) over v200 end as d
 from v_daily_long window v50 as (partition by symbol order by date_et rows between 49 preceding and current row), v200 as (partition by symbol order by date_et rows between 199 preceding and current row)),
 b as (select *, lag(d) over (partition by symbol order by date_et) as p from a)
 select symbol, date_et, case when d > 0 and p < 0 then 1 when d < 0 and p > 0 then -1 else 0 end as cross_ from b""")
def golden_cross(m):
    return I.golden_cross(m.daily_long).select("symbol", "date_et", F.col("cross").alias("cross_"))


@query(f"select symbol, date_et, {r('(volume - avg(volume) over p) / nullif(stddev_samp(volume) over p, 0)')} as volume_z, {r('volume / nullif(avg(volume) over v, 0)')} as volume_ratio, {r('close / nullif(lag(close, 5) over w, 0) - 1')} as ret5 from v_daily_long window p as (partition by symbol), v as (partition by symbol order by date_et rows between 19 preceding and current row), w as (partition by symbol order by date_et)")
def volume_features(m):
    w, p, x = S.by("symbol", order="date_et"), S.Window.partitionBy("symbol"), F.col("volume").cast("double")
    z = F.try_divide(x - F.avg(x).over(p), F.stddev_samp(x).over(p))
    return rounded(m.daily_long.select("symbol", "date_et", z.alias("volume_z"), F.try_divide(x, S.rolling(x, w, 20, least=1)).alias("volume_ratio"), (F.try_divide(F.col("close"), F.lag("close", 5).over(w)) - 1).alias("ret5")))


@query("select symbol, date_et, count(*) over v as n, " + r("list_sum(list(close) over v)") + " as total from v_daily_long window v as (partition by symbol order by date_et rows between 19 preceding and current row)")
def sequences(m):
    """The last 20 rows of each symbol as one array, here by its length and sum."""
    a = F.collect_list("close").over(S.by("symbol", order="date_et").rowsBetween(-19, 0))
    return rounded(m.daily_long.select("symbol", "date_et", F.size(a).cast("long").alias("n"), F.aggregate(a, F.lit(0.0), lambda s, x: s + x).alias("total")))


@query(f"""with a as (select symbol, cast(datetime as date) as day, count(*) as n, max_by(close, datetime) as l, min_by(close, datetime) as f from v_price where session = 'pre' group by symbol, cast(datetime as date))
 select symbol, day, {r('case when n >= 2 then l / f - 1 end')} as pre_ret from a""")
def pre_market_return(m):
    return rounded(I.pre_market_return(m.price).select("symbol", "day", "pre_ret"))


@query("select symbol, date_et, lag(label) over (partition by symbol order by date_et) as label from (select symbol, date_et, case when ret * 100 < -2.5 then 0 when ret * 100 < -0.6 then 1 when ret * 100 < 0.6 then 2 when ret * 100 < 2.5 then 3 when ret is not null then 4 end as label from v_daily_long) a")
def yesterday_label(m):
    from foreopen.sources.market import label_of

    return m.daily_long.select("symbol", "date_et", F.lag(label_of(F.col("ret") * 100)).over(S.by("symbol", order="date_et")).alias("label"))


@query(f"""with recursive chg as (select symbol, date_et, greatest(coalesce(ch, 0), 0) as up, greatest(coalesce(-ch, 0), 0) as dn from {_CHANGE} a),
{_RSI_SEED('up', 'u')}, {_RSI_SEED('dn', 'v')}, {_MACD},
b as (select symbol, date_et, close, row_number() over w as rn, close / nullif(lag(close) over w, 0) - 1 as ret1, close / nullif(lag(close, 5) over w, 0) - 1 as ret5, volume / nullif(avg(volume) over v, 0) as vol_ratio,
 {_BB.format('avg(close) over v')} as mid, {_BB.format('stddev_pop(close) over v')} as sd from v_daily_long window w as (partition by symbol order by date_et), v as (partition by symbol order by date_et rows between 19 preceding and current row))
select b.symbol, b.date_et, {r('ret1')} as ret1, {r('ret5')} as ret5, {r('vol_ratio')} as vol_ratio, {r('case when fu.s is null then null when fv.s = 0 then 100.0 else 100 - 100 / (1 + fu.s / fv.s) end')} as rsi14,
 {r('(d.macd - f3.s) / b.close')} as macd_hist, {r('(b.close - (mid - 2 * sd)) / nullif(4 * sd, 0)')} as pct_b, {r('4 * sd / mid')} as band_width from b
 left join fu on fu.symbol = b.symbol and fu.date_et = b.date_et left join fv on fv.symbol = b.symbol and fv.date_et = b.date_et
 left join d on d.symbol = b.symbol and d.date_et = b.date_et left join f3 on f3.symbol = b.symbol and f3.date_et = b.date_et where rn >= 30""")
def sample_features(m):
    return rounded(I.sample_features(m.daily_long))
