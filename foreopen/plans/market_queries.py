"""Point-in-time reads, calendar, labels, and the price, earnings and analyst blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreopen.functions import series as S
from foreopen.operators import features as X
from foreopen.operators.asof import to_next_cutoff, to_target
from foreopen.plans.registry import query, r, rnd, rounded
from foreopen.sources import market as M

NINE = "interval '570' minute"


@query("select doc_id, known_at, symbols, title from v_news where known_at >= timestamp '2024-01-05 09:30:00' and known_at < timestamp '2024-01-12 09:30:00'")
def pit_scan_news(m):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return M.as_of(m.news, at("2024-01-12 09:30:00"), at("2024-01-05 09:30:00"), columns=["doc_id", "known_at", "symbols", "title"])


@query(f"select symbol, datetime, session, {r('close')} as close from v_price where known_at < timestamp '2024-01-10 09:30:00' and symbol in ('TAA', 'TAB')")
def pit_scan_price(m):
    return rounded(M.as_of(m.price, F.lit("2024-01-10 09:30:00").cast("timestamp_ntz"), symbols=["TAA", "TAB"]).select("symbol", "datetime", "session", "close"))


@query("select doc_id, symbols from v_news where known_at < timestamp '2024-01-20 09:30:00' and (list_contains(string_split(symbols, ','), 'TAC') or list_contains(string_split(symbols, ','), 'TBA'))")
def pit_tag_filter(m):
    return M.as_of(m.news, F.lit("2024-01-20 09:30:00").cast("timestamp_ntz"), symbols=["TAC", "TBA"]).select("doc_id", "symbols")


@query("select conv_id, turn, kind, created_et from v_reddit where created_et >= timestamp '2024-01-03' and created_et < timestamp '2024-01-25' and sub = 'sub3'")
def reddit_scan(m):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return M.reddit_rows(m.reddit, at("2024-01-25"), at("2024-01-03"), sub="sub3").select("conv_id", "turn", "kind", "created_et")


@query("select distinct sub from v_reddit")
def subreddits(m):
    return m.reddit.select("sub").distinct()


@query("select date, target from v_calendar")
def calendar_next_day(m):
    return m.calendar.select("date", "target")


@query("select date, target from v_calendar where date >= date '2024-01-08' and target is not null")
def base_days(m):
    return M.base_days(m.calendar, "2024-01-08").select("date", "target")


@query("select date, target, case when target < date '2024-01-16' then 'train' else 'test' end as part from v_calendar where target is not null")
def split_train_test(m):
    return M.split_on(m.calendar.where("target is not null"), "2024-01-16").select("date", "target", "part")


@query("select date, target, coalesce(lag(date, 4) over (order by date), first_value(date) over (order by date))::timestamp as start from v_calendar")
def start_of_days(m):
    return M.start_of(m.calendar, days=5).select("date", "target", "start")


@query(f"select date, target, target::timestamp + {NINE} - interval '36' hour as start from v_calendar where target is not null")
def start_of_hours(m):
    return M.start_of(m.calendar.where("target is not null"), hours=36).select("date", "target", "start")


def label_sql(x: str) -> str:
    return f"case when {x} < -2.5 then 0 when {x} < -0.6 then 1 when {x} < 0.6 then 2 when {x} < 2.5 then 3 when {x} is not null then 4 end"


_LABELS = f"select symbol, date_et as date, ret * 100 as ret_pct, {label_sql('ret * 100')} as label from v_daily where ret is not null"


@query(f"select symbol, date, {r('ret_pct')} as ret_pct, label from ({_LABELS}) a")
def labels_daily(m):
    return rounded(M.labels(m.daily))


@query(f"select label, count(*) as n, {r('count(*) * 100.0 / sum(count(*)) over ()')} as share from ({_LABELS}) a group by label")
def label_balance(m):
    n = M.labels(m.daily).groupBy("label").agg(F.count("*").alias("n"))
    return n.withColumn("share", rnd(F.col("n") * 100.0 / F.sum("n").over(S.Window.partitionBy())))


@query("select label, " + ", ".join(f"count(*) filter (pred = {j}) as p{j}" for j in range(5)) + " from v_pred group by label")
def label_crosstab(m):
    p = m.predictions.groupBy("label").pivot("pred", [0, 1, 2, 3, 4]).count().fillna(0)
    return p.select("label", *[F.col(str(j)).alias(f"p{j}") for j in range(5)])


@query("select distinct symbol from v_daily where ret is not null")
def symbols_known(m):
    return M.labels(m.daily).select("symbol").distinct()


@query(f"select n.doc_id, c.target from v_news n join v_calendar c on c.target is not null and n.known_at >= c.date::timestamp + {NINE} and n.known_at < c.target::timestamp + {NINE}")
def asof_bounded(m):
    return to_target(m.news, m.calendar).select("doc_id", "target")


@query(f"""select n.doc_id, case when n.known_at < (select min(date)::timestamp + {NINE} from v_calendar) then null
 else (select min(c.date) from v_calendar c where c.date::timestamp + {NINE} > n.known_at) end as target from v_news n""")
def asof_forward(m):
    return to_next_cutoff(m.news, m.calendar.select(F.col("date").alias("target"))).select("doc_id", "target")


_HOURS = f"""hours as (select symbol, datetime::date as day, max_by(close, datetime) filter (session = 'pre' and known_at < datetime::date::timestamp + {NINE}) as pre_last,
 max_by(close, datetime) filter (session = 'post') as post_last from v_price group by symbol, datetime::date)"""


@query(f"with {_HOURS} select symbol, day, {r('pre_last')} as pre_last, {r('post_last')} as post_last from hours")
def ext_hours_last(m):
    return rounded(X.extended_hours(m.price))


def _block(view: str) -> str:
    loo = f"(select case when count(b.ret) >= 3 then median(b.ret) end from {view} b where b.date_et = a.date_et and b.symbol <> a.symbol)"
    win = lambda n: f"window_{n} as (partition by symbol order by date rows between {n - 1} preceding and current row)"
    roll = lambda agg, x, n: f"case when count({x}) over window_{n} >= {max(2, n // 2)} then {agg}({x}) over window_{n} end"
    mean = lambda x: roll("avg", x, 60)
    return f"""b0 as (select symbol, date_et as date, close as close_d0, ret * 100 as r, {loo} * 100 as rm,
 greatest(high - low, abs(high - prev_close), abs(low - prev_close)) / close * 100 as tr, case when ret is not null then (abs(ret * 100) >= 2.5)::int::double end as big from {view} a),
b1 as (select *, r * rm as x, rm * rm as xx from b0),
blk as (select symbol, date, close_d0, {roll('stddev_samp', 'r', 5)} as vol5, {roll('stddev_samp', 'r', 20)} as vol20, {roll('avg', 'tr', 14)} as atr14, {roll('avg', 'big', 60)} as big_rate60,
 coalesce((({mean('x')}) - ({mean('r')}) * ({mean('rm')})) / nullif(({mean('xx')}) - ({mean('rm')}) * ({mean('rm')}), 0) * 0.5 + 0.5, 1.0) as beta60
 from b1 window {win(5)}, {win(14)}, {win(20)}, {win(60)})"""


PANEL = f"""{_block('v_daily')}, {_HOURS},
p0 as (select b.*, c.target, h.pre_last, g.post_last from blk b join v_calendar c on b.date = c.date and c.target is not null
 left join hours h on h.symbol = b.symbol and h.day = c.target left join hours g on g.symbol = b.symbol and g.day = b.date),
p1 as (select symbol, date, target, close_d0, vol5, vol20, atr14, big_rate60, beta60, (pre_last is null and post_last is not null)::int::double as gap_fallback,
 (coalesce(pre_last, post_last) is null)::int::double as gap_missing, (coalesce(pre_last, post_last) / close_d0 - 1) * 100 as gap_pct from p0),
p2 as (select *, case when gap_pct is not null then (rank() over (partition by target order by gap_pct nulls last) + (count(*) over (partition by target, gap_pct) - 1) / 2.0) / nullif(count(gap_pct) over (partition by target), 0) end as gap_rank,
 case when gap_pct is not null and vol20 is not null then greatest(least(gap_pct / greatest(vol20, 0.5), 10.0), -10.0) end as zgap,
 (select case when count(b.gap_pct) >= 3 then median(b.gap_pct) end from p1 b where b.target = a.target and b.symbol <> a.symbol) as mkt_gap from p1 a),
reg as (select target, median(vol20) as reg_med_vol20, median(abs(gap_pct)) as reg_med_absgap, stddev_samp(gap_pct) as reg_gap_disp, median(gap_pct) as reg_mkt_gap,
 avg((abs(gap_pct) >= 1.0)::int::double) as reg_big_ratio from p1 group by target),
panel as (select p2.*, gap_pct - beta60 * mkt_gap as resid_gap, reg.* exclude (target) from p2 join reg on reg.target = p2.target),
truth as ({_LABELS}),
labelled as (select p.*, t.ret_pct, t.label, (ln(1 + t.ret_pct / 100) - ln(1 + p.gap_pct / 100)) * 100 as rest from panel p join truth t on t.symbol = p.symbol and t.date = p.target)"""
_GAPS = ["close_d0", "gap_fallback", "gap_missing", "gap_pct", "gap_rank", "zgap", "mkt_gap", "resid_gap"]


def panel(m):
    return X.gaps(X.daily_block(m.daily), X.extended_hours(m.price), m.calendar)


def labelled(m):
    return X.with_labels(panel(m), m.daily)


def _cols(names, prefix: str = "") -> str:
    return ", ".join(f"{r(prefix + c)} as {c}" for c in names)


@query(f"with {PANEL} select symbol, date, target, {_cols(_GAPS)} from panel")
def gap_features(m):
    return rounded(panel(m).select("symbol", "date", "target", *_GAPS))


@query(f"with {PANEL} select symbol, target, {r('gap_rank')} as gap_rank from panel")
def gap_pct_rank(m):
    return rounded(panel(m).select("symbol", "target", "gap_rank"))


@query(f"with {PANEL} select symbol, target, {r('mkt_gap')} as mkt_gap from panel")
def mkt_gap_loo(m):
    return rounded(panel(m).select("symbol", "target", "mkt_gap"))


@query(f"with {PANEL} select target, {_cols(X.GROUPS['regime'])} from reg")
def regime_stats(m):
    return rounded(X.regime(panel(m).drop(*X.GROUPS["regime"])))


@query(f"""with h as (select symbol, datetime::date as day, max_by(close, datetime) filter (session = 'pre' and known_at <= datetime::date::timestamp + {NINE}) as leak,
 max_by(close, datetime) filter (session = 'pre' and known_at < datetime::date::timestamp + {NINE}) as fair from v_price group by symbol, datetime::date)
 select symbol, day, {r('leak')} as leak, {r('fair')} as fair from h""")
def gap_leak(m):
    leak = X.extended_hours(m.price, leak=True).select("symbol", "day", F.col("pre_last").alias("leak"))
    return rounded(leak.join(X.extended_hours(m.price).select("symbol", "day", F.col("pre_last").alias("fair")), ["symbol", "day"]))


@query(f"with {PANEL} select symbol, target, label, {r('ret_pct')} as ret_pct, {r('rest')} as rest from labelled")
def panel_labels(m):
    return rounded(labelled(m).select("symbol", "target", "label", "ret_pct", "rest"))


for _name, _own in {"roll_vol": ["vol5", "vol20"], "roll_atr_mean": ["atr14"], "roll_big_rate": ["big_rate60"], "roll_beta": ["beta60"]}.items():

    def _f(m, own=tuple(_own)):
        return rounded(X.daily_block(m.daily_long).select("symbol", "date", *own))

    _f.__name__ = _name
    query(f"with {_block('v_daily_long')} select symbol, date, {_cols(_own)} from blk")(_f)

_WINDOWED = lambda view, cols: f"(select e.*, c.target from {view} e join v_calendar c on c.target is not null and e.known_at >= c.date::timestamp + {NINE} and e.known_at < c.target::timestamp + {NINE})"
_EARN = f"""ew as {_WINDOWED('v_earnings', '')},
earn as (select symbol, target, 1.0::double as earn, max_by(sign(surprise_pct), struct_pack(a := known_at, b := greatest(least(surprise_pct, 50.0), -50.0))) filter (surprise_pct is not null)::double as surp_sign,
 max_by(abs(greatest(least(surprise_pct, 50.0), -50.0)), struct_pack(a := known_at, b := greatest(least(surprise_pct, 50.0), -50.0))) filter (surprise_pct is not null) as surp_abs,
 max_by(greatest(least(surprise_pct, 50.0), -50.0), struct_pack(a := known_at, b := greatest(least(surprise_pct, 50.0), -50.0))) filter (surprise_pct is not null) as surp_pct_w from ew group by symbol, target)"""
_ANALYST = f"""aw as {_WINDOWED('v_analyst', '')},
an as (select symbol, target, count(*)::double as an_n, sum((action = 'up')::int)::double as an_up, sum((action = 'down')::int)::double as an_down,
 avg(case when target_current / nullif(target_prior, 0) is not null then greatest(least(target_current / nullif(target_prior, 0) - 1, 0.5), -0.5) end) as an_tgt_chg from aw group by symbol, target)"""


@query(f"with {_EARN} select symbol, target, earn, {_cols(['surp_sign', 'surp_abs', 'surp_pct_w'])} from earn")
def earnings_block(m):
    return rounded(X.earnings_block(m.earnings, m.calendar))


@query(f"with {_ANALYST} select symbol, target, an_n, an_up, an_down, {r('an_tgt_chg')} as an_tgt_chg from an")
def analyst_block(m):
    return rounded(X.analyst_block(m.analyst, m.calendar))


@query(f"""with {PANEL}, {_ANALYST} select p.symbol, p.target, coalesce(sign(coalesce(an_up, 0) - coalesce(an_down, 0)) * sign(gap_pct), 0)::double + 0.0 as an_gap_agree
 from panel p left join an on an.symbol = p.symbol and an.target = p.target""")
def an_gap_agree(m):
    x = panel(m).join(X.analyst_block(m.analyst, m.calendar), ["symbol", "target"], "left").fillna(0.0, ["an_up", "an_down"])
    return x.select("symbol", "target", (F.coalesce(F.signum(F.col("an_up") - F.col("an_down")) * F.signum("gap_pct"), F.lit(0.0)) + F.lit(0.0)).alias("an_gap_agree"))


_ALL = ["close_d0", "gap_fallback", "gap_missing", *X.GROUPS["core"], *X.GROUPS["scale"], *X.GROUPS["cross"], *X.GROUPS["event"], *X.GROUPS["analyst"], *X.GROUPS["regime"]]
_FILLED = {c: f"coalesce({c}, 0)" for c in ("earn", "an_n", "an_up", "an_down")} | {"an_gap_agree": "coalesce(sign(coalesce(an_up, 0) - coalesce(an_down, 0)) * sign(gap_pct), 0)"}


@query(f"""with {PANEL}, {_EARN}, {_ANALYST} select p.symbol, p.date, p.target, {', '.join(f'{r(_FILLED.get(c, c))} as {c}' for c in _ALL)}
 from panel p left join earn on earn.symbol = p.symbol and earn.target = p.target left join an on an.symbol = p.symbol and an.target = p.target""")
def feature_panel(m):
    return rounded(X.build_features(m, ["scale", "cross", "event", "analyst", "regime"]).select("symbol", "date", "target", *_ALL))


@query("select 'gap_pct' as \"column\", 0::bigint as null_diff, 0::bigint as beyond union all select 'zgap', 0, 0 union all select 'resid_gap', 0, 0")
def parity_diff(m):
    """The batch panel against the per-day path on one target day: no null and no value may differ."""
    from foreopen.operators.experiments import parity

    day = m.calendar.where("target is not null").agg(F.max("target")).first()[0]
    batch = X.build_features(m, ["scale", "cross"]).where(F.col("target") == F.lit(day))
    return parity(batch, X.day_features(m, day, ["scale", "cross"]), ["gap_pct", "zgap", "resid_gap"]).select("column", "null_diff", "beyond")
