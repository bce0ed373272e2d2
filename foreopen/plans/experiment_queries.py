"""Draws, folds, bootstrap, verdicts, explanations and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreopen.operators import decisions as D
from foreopen.operators import experiments as E
from foreopen.operators.asof import to_target
from foreopen.operators.features import analyst_block
from foreopen.plans.market_queries import PANEL, label_sql, labelled
from foreopen.plans.market_queries import _ANALYST as ANALYST
from foreopen.plans.registry import query, r, rounded, score_ctes


def draw(*parts: str) -> str:
    return f"('0x' || substr(md5({' || chr(47) || '.join(parts)}), 1, 8))::bigint"


@query("select target, " + ", ".join(f"count(*) filter (label = {i} and pred = {j}) as c{i}{j}" for i in range(5) for j in range(5)) + " from v_pred group by target")
def day_confusions(m):
    return E.day_confusions(m.predictions)


_REPS, _LEN = 40, 5
_BLOCKS = f"""dd as (select count(distinct target) as d from v_pred), bk as (select rep, b, d, least({_LEN}, d) as len from range({_REPS}) t(rep) cross join dd, lateral (select unnest(range((ceil(d / least({_LEN}, d)))::bigint)) as b) z),
bs as (select *, {draw("'3'", 'rep::varchar', 'b::varchar')} % (d - len + 1) as start from bk),
bd as (select rep, (start + j)::int as di, count(*) as w from bs, lateral (select unnest(range(len)) as j) z where b * len + j < d group by rep, start + j)"""


@query(f"with {_BLOCKS} select rep::int as rep, di, w from bd")
def block_bootstrap(m):
    return E.block_days(m.predictions, _REPS, _LEN, seed=3)


def _two(m):
    return m.predictions.withColumn("base", F.lit(2)).withColumn("other", D.by_bounds(F.col("s") * 0.5, D.CUTS))


_UNIT = "fold, draw"
_BOOT = f"""u as (select fold, draw, target, label, 2 as base, case when s * 0.5 < -2.5 then 0 when s * 0.5 < -0.6 then 1 when s * 0.5 < 0.6 then 2 when s * 0.5 < 2.5 then 3 else 4 end as cand from v_pred),
ud as (select fold, draw, target, row_number() over (partition by fold, draw order by target) - 1 as di from (select distinct fold, draw, target from u) z),
ob as (select u.fold, u.draw, d.di, 0 as who, label as y, base as q, count(*) as o from u join ud d on d.fold = u.fold and d.draw = u.draw and d.target = u.target group by all
 union all select u.fold, u.draw, d.di, 1, label, cand, count(*) from u join ud d on d.fold = u.fold and d.draw = u.draw and d.target = u.target group by all),
sz as (select fold, draw, count(*) as d, least({_LEN}, count(*)) as len from ud group by fold, draw),
bs as (select fold, draw, rep, b, d, len, {draw("'1'", 'fold', 'draw::varchar', 'rep::varchar', 'b::varchar')} % (d - len + 1) as start from sz cross join range({_REPS}) t(rep), lateral (select unnest(range((ceil(d / len))::bigint)) as b) z),
bw as (select fold, draw, rep, start + j as di, count(*) as w from bs, lateral (select unnest(range(len)) as j) z where b * len + j < d group by all),
ro as (select ob.fold, ob.draw, bw.rep, who, y, q, o * w as o from ob join bw on bw.fold = ob.fold and bw.draw = ob.draw and bw.di = ob.di),
{score_ctes('ro', 'fold, draw, rep, who')}, {score_ctes('ob', 'fold, draw, who', 'point')},
dl as (select fold, draw, rep, case when count(score) = 2 then sum(case when who = 1 then score else -score end) end as delta from scored group by fold, draw, rep),
rp as (select rep, avg(delta) as delta from dl group by rep), pt as (select avg(x) as delta from (select fold, draw, sum(case when who = 1 then score else -score end) as x from point group by fold, draw) z)"""


@query(f"""with {_BOOT} select {r('(select delta from pt)')} as delta, {r('quantile_cont(delta, 0.025)')} as ci_low, {r('quantile_cont(delta, 0.975)')} as ci_high, {r('stddev_pop(delta)')} as se,
 {r('least(1.0, 2 * least(avg((delta <= 0)::int::double), avg((delta >= 0)::int::double)))')} as p from rp""")
def paired_delta_ci(m):
    return rounded(E.paired_bootstrap(_two(m), "base", "other", ["fold", "draw"], _REPS, _LEN, seed=1))


_PS = "ps as (select c_mktsegment as name, round(avg(c_acctbal) / 100000, 6) as p from customer group by c_mktsegment)"


@query(f"""with {_PS}, s as (select name, p, least(1.0, (greatest(count(*) over (), 6) - row_number() over (order by p, name) + 1) * p) as x from ps)
 select name, {r('p')} as p, {r('max(x) over (order by p, name rows unbounded preceding)')} as p_holm from s""")
def holm_adjust(m):
    ps = m.raw("customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.round(F.avg("c_acctbal") / 100000, 6).alias("p"))
    return rounded(E.holm(ps, "name", "p", family=6))


_ROWS = """k as (select c_nationkey, (c_nationkey % 7 - 2) * 0.01 as delta, (c_nationkey % 5 - 2) * 0.01 as ci_low, (c_nationkey % 9 - 1) * 0.01 as ci_high, (c_nationkey % 3 - 1) * 0.01 as unseen_delta, (c_nationkey % 4) * 0.01 as flip_diff, 0.7 + (c_nationkey % 6) * 0.1 as extreme_ratio,
 [(c_nationkey % 7 - 1) * 0.01, (c_nationkey % 5 - 1) * 0.01, (c_nationkey % 2) * 0.01] as folds from (select distinct c_nationkey from customer) z),
d as (select *, len(list_filter(folds, lambda v: v < -0.005)) as neg, len(list_filter(folds, lambda v: v > 0)) as pos from k),
e as (select *, list_filter([case when ci_high < 0 then 'ci_high' end, case when neg >= 2 then 'negative_folds' end], lambda x: x is not null) as bad,
 list_filter([case when not pos >= 3 then 'positive_folds' end, case when not ci_low > 0 then 'ci_low' end, case when not unseen_delta > 0 then 'unseen' end, case when not list_min(folds) >= -0.02 then 'worst_fold' end,
 case when not flip_diff <= 0.02 then 'flips' end, case when not abs(extreme_ratio - 1) <= 0.25 then 'extremes' end, case when not delta >= 0.0 then 'gain' end], lambda x: x is not null) as failed from d)"""


@query(f"with {_ROWS} select c_nationkey, case when len(bad) > 0 then 'reject' when len(failed) = 0 then 'adopt' else 'hold' end as verdict, array_to_string(case when len(bad) > 0 then bad else failed end, ',') as reasons from e")
def decide_rule(m):
    k = F.col("c_nationkey")
    d = lambda n, off: ((k % n - off) * F.lit(0.01))
    rows = m.raw("customer").select("c_nationkey").distinct().select(
        k, d(7, 2).alias("delta"), d(5, 2).alias("ci_low"), d(9, 1).alias("ci_high"), d(3, 1).alias("unseen_delta"), d(4, 0).alias("flip_diff"), (F.lit(0.7) + (k % 6) * F.lit(0.1)).alias("extreme_ratio"),
        F.array(d(7, 1), d(5, 1), d(2, 0)).alias("folds"),
    )
    return E.decide(rows).select("c_nationkey", "verdict", "reasons")


@query(f"""with s as (select distinct symbol from v_daily), d as (select symbol, draw::int as draw, row_number() over (partition by draw order by {draw("'0'", 'draw::varchar', 'symbol')}, symbol) as rk from s cross join range(3) t(draw)),
 g as (select *, rk <= 5 as un, row_number() over (partition by draw, rk <= 5 order by {draw("'0-groups'", 'draw::varchar', 'symbol')}, symbol) - 1 as gi, count(*) over (partition by draw, rk <= 5) as n from d)
 select draw, symbol, case when un then 'unseen' when gi < 4 then 'seen_test' else 'train' end as role, case when not un then (gi % ceil(n / 6.0)::bigint)::int end as universe from g""")
def universe_draws(m):
    return E.universe_draws(m.daily, 3, 5, 4, 6)


_FOLDS = [("A", "2024-01-10", "2024-01-17"), ("B", "2024-01-17", "2024-01-24")]


@query("""with f(fold, a, b) as (values ('A', date '2024-01-10', date '2024-01-17'), ('B', date '2024-01-17', date '2024-01-24'))
 select fold, date, target, case when target >= a then 'test' else 'train' end as part from v_calendar cross join f where target is not null and ((target >= a and target < b) or target < a - 2)""")
def fold_masks(m):
    folds = m.spark.createDataFrame(_FOLDS, "fold string, start string, end string").withColumns({c: F.col(c).cast("date") for c in ("start", "end")})
    return E.fold_part(folds, m.calendar.where("target is not null"), 2).select("fold", "date", "target", "part")


@query(f"select event_id, event_type from (select event_id, event_type, row_number() over (partition by event_type order by {draw("'7'", 'event_id::varchar')}, event_id) as k from events) a where k <= 20")
def stratified_sample(m):
    return E.stratified(m.raw("events"), 20, ["event_type"], "event_id", seed=7).select("event_id", "event_type")


@query("select symbol, date_et, " + r("close") + " as close from (select *, row_number() over (partition by symbol order by close desc, date_et) as k from v_daily_long) a where k <= 3")
def top_closes(m):
    w = D.Window.partitionBy("symbol").orderBy(F.desc("close"), "date_et")
    return rounded(m.daily_long.withColumn("k", F.row_number().over(w)).where("k <= 3").select("symbol", "date_et", "close"))


@query("select symbol, date_et from (select *, row_number() over (partition by symbol order by date_et desc) as k from v_daily_long) a where k <= 30")
def history_tail(m):
    w = D.Window.partitionBy("symbol").orderBy(F.desc("date_et"))
    return m.daily_long.withColumn("k", F.row_number().over(w)).where("k <= 30").select("symbol", "date_et")


@query("select target from v_pred where target < date '2024-01-15' group by target")
def dev_days(m):
    return E.dev_only(m.predictions, "2024-01-15").select("target").distinct()


_GAP_BIN = "case when abs(gap_pct) >= 2.5 then 3 when abs(gap_pct) >= 1.0 then 2 when abs(gap_pct) >= 0.5 then 1 when abs(gap_pct) >= 0 then 0 end"


@query(f"""with {PANEL}, {ANALYST}, x as (select l.*, coalesce(an_up, 0) as up_, coalesce(an_down, 0) as dn_ from labelled l left join an on an.symbol = l.symbol and an.target = l.target)
 select {_GAP_BIN} as gap_bin, case when up_ > dn_ then 'upgrade' when dn_ > up_ then 'downgrade' else 'none' end as category, count(*) as n, {r('avg((ret_pct > 0)::int::double)')} as up_rate, {r('avg((label in (0, 4))::int::double)')} as "M_rate", {r('avg(rest)')} as rest_mean, {r('avg(ret_pct)')} as ret_mean
 from x where gap_pct is not null group by 1, 2""")
def gap_conditional(m):
    x = labelled(m).join(analyst_block(m.analyst, m.calendar), ["symbol", "target"], "left").fillna(0.0, ["an_up", "an_down"])
    return rounded(E.gap_conditional(x, E.EVENTS["analyst"]()))


_EDGES = "e as (select list_distinct(quantile_cont(s, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) as q from v_pred)"


@query(f"""with {_EDGES}, b as (select s, label, len(list_filter(list_sort(q)[2:len(q) - 1], lambda x: v.s > x))::int as bin from v_pred v cross join e)
 select bin, {r('median(s)')} as x, count(*) as n, {r('avg(label)')} as y from b group by bin""")
def binned_means(m):
    return rounded(E.binned(m.predictions, "s", "label"))


@query(f"""with k as (select fold, rank() over (partition by fold order by s) + (count(*) over (partition by fold, s) - 1) / 2.0 as rx, rank() over (partition by fold order by label) + (count(*) over (partition by fold, label) - 1) / 2.0 as ry from v_pred)
 select fold, {r('corr(rx, ry)')} as rho, count(*) as n from k group by fold""")
def spearman(m):
    return rounded(E.spearman(m.predictions, "s", "label", "fold"))


_PERM = f"""dy as (select target, row_number() over (order by target) - 1 as di from (select distinct target from panel) z), bl as (select (di // 5)::int as b, count(*) as size from dy group by 1),
od as (select b as pb, size as ps, row_number() over (order by {draw("'0'", "'0'", 'b::varchar')}, b) - 1 as b from bl),
mp as (select dy.target, od.pb * 5 + (dy.di % 5) % od.ps as src from dy join od on od.b = dy.di // 5), mf as (select mp.target, dy.target as from_ from mp join dy on dy.di = mp.src)"""


@query(f"with {PANEL}, {_PERM} select p.symbol, p.target, {r('q.gap_pct')} as gap_pct from panel p join mf on mf.target = p.target left join panel q on q.symbol = p.symbol and q.target = mf.from_")
def block_permute(m):
    from foreopen.plans.market_queries import panel

    return rounded(E.block_permuted(panel(m).select("symbol", "target", "gap_pct"), ["gap_pct"], 5))


_GRID = ", ".join(repr(0.05 + 0.9 * i / 9) for i in range(10))


@query(f"""with g as (select unnest(list_distinct(quantile_cont(s, [{_GRID}]))) as grid from v_pred), x as (select grid, symbol, (grid + s * 0.1 >= 2.5 or grid + s * 0.1 < -2.5)::int::double as e from v_pred cross join g)
 select {r('grid')} as grid, coalesce(symbol, 'ALL') as symbol, {r('avg(e)')} as pred_extreme from x group by grouping sets ((grid), (grid, symbol))""")
def pdp_grid(m):
    return rounded(E.pdp(m.predictions, "s", lambda g: D.by_bounds(g + F.col("s") * 0.1, D.CUTS)))


@query("""with w as (select distinct symbol, target from v_pred where target < date '2024-01-06'), p as (select symbol, target, min(case when symbol = 'TAA' then 7 else label end) as label from v_pred where symbol <> 'TAB' and target < date '2024-01-07' group by symbol, target),
 a as (select 'label' as problem, symbol, target from p where label is null or label not between 0 and 4 union all select 'missing', symbol, target from w where not exists (select 1 from p where p.symbol = w.symbol and p.target = w.target)
 union all select 'extra', symbol, target from p where not exists (select 1 from w where p.symbol = w.symbol and p.target = w.target))
 select problem, symbol, target from (select *, row_number() over (partition by problem order by target, symbol) as k from a) z where k <= 5""")
def validate_output(m):
    day = lambda x: F.col("target") < F.lit(x).cast("date")
    wanted = m.predictions.where(day("2024-01-06")).select("symbol", "target").distinct()
    p = m.predictions.where((F.col("symbol") != "TAB") & day("2024-01-07")).groupBy("symbol", "target").agg(F.min(F.when(F.col("symbol") == "TAA", 7).otherwise(F.col("label"))).alias("label"))
    return E.validate(p, wanted).select("problem", "symbol", "target")


@query("select a.symbol from (select distinct symbol from v_daily) a where a.symbol not in (select symbol from v_earnings where symbol is not null)")
def symbols_without_earnings(m):
    return m.daily.select("symbol").distinct().exceptAll(m.earnings.select("symbol").distinct())


@query("select symbol from v_daily intersect select symbol from v_earnings")
def symbols_in_both(m):
    return m.daily.select("symbol").intersect(m.earnings.select("symbol"))


@query(f"with x as (select grouping(fold) as g, fold, count(*) as n, avg(s) as s from v_pred group by rollup(fold)) select coalesce(fold, 'ALL') as fold, n, {r('s')} as s from x")
def report_table(m):
    return rounded(m.predictions.rollup("fold").agg(F.count("*").alias("n"), F.avg("s").alias("s")).select(F.coalesce("fold", F.lit("ALL")).alias("fold"), "n", "s"))


@query(None)
def explain_rows(m):
    """How far the gap rule's score falls when gaps trade days, over three shuffles."""
    x = labelled(m).select("symbol", "target", "gap_pct", "label").cache()
    out = None
    for rep in range(3):
        y = E.block_permuted(x.select("symbol", "target", "gap_pct", "label"), ["gap_pct"], 5, rep=rep)
        s = D.score_counts(D.counts(D.gap_rule(y))).select(F.lit(rep).alias("rep"), "score")
        out = s if out is None else out.unionByName(s)
    return out.crossJoin(D.score_counts(D.counts(D.gap_rule(x))).select(F.col("score").alias("base"))).withColumn("drop", F.col("base") - F.col("score"))


__all__ = ["to_target"]


@query("""with f(fold, a) as (values ('wf 2024-01', date '2024-01-12'), ('wf 2024-02', date '2024-02-01')), d as (select distinct symbol, target from v_pred)
 select fold as split, symbol, target, case when target >= a then 'test' else 'train' end as part from d cross join f where (target >= a and target < a + 5) or target < a - 2""")
def walk_forward(m):
    from foreopen.plans.runs import splits

    return splits(m.predictions, "walk_forward", starts=["2024-01-12", "2024-02-01"], horizon_days=5, embargo_days=2)


_HELD = f"""d as (select distinct symbol, target from v_pred), h as (select symbol, i, row_number() over (partition by i order by {draw("'0'", 'i::varchar', 'symbol')}, symbol) <= 4 as held from (select distinct symbol from d) z cross join range(3) t(i))"""


@query(f"with {_HELD} select 'symbol_holdout ' || i as split, d.symbol, target, case when held then 'test' else 'train' end as part from d join h on h.symbol = d.symbol")
def symbol_holdout(m):
    from foreopen.plans.runs import splits

    return splits(m.predictions, "symbol_holdout", n_sets=3, k=4)


@query(f"""with {_HELD} select 'time_symbol_holdout ' || i as split, d.symbol, target, case when held then 'test' else 'train' end as part from d join h on h.symbol = d.symbol
 where (held and target >= date '2024-01-15') or (not held and target < date '2024-01-15' - 3)""")
def time_symbol_holdout(m):
    from foreopen.plans.runs import splits

    return splits(m.predictions, "time_symbol_holdout", n_sets=3, k=4, start="2024-01-15", embargo_days=3)


_DRAW = draw("'0'", "symbol", "target::varchar", "text")


@query(f"""with p as (select sub as symbol, created_et::date as target, body as text, created_et, turn as ticker_mentions, length(body) as n from v_reddit),
 u as ((select symbol, target, text, 'random' as sample_type, 0 as i from p order by {_DRAW}, symbol, target, text limit 10)
 union all (select symbol, target, text, 'long', 1 from p order by n desc, created_et desc, symbol, target, text limit 10)
 union all (select symbol, target, text, 'ticker_repeat', 2 from p order by ticker_mentions desc, created_et desc, symbol, target, text limit 10)
 union all (select symbol, target, text, 'recent', 3 from p order by created_et desc, symbol, target, text limit 10)),
 o as (select * from u qualify row_number() over (partition by symbol, target, text order by i) = 1),
 r as (select symbol, target, text, 'random_fill' as sample_type, 4 as i from p where not exists (select 1 from o where o.symbol = p.symbol and o.target = p.target and o.text = p.text) order by {_DRAW}, symbol, target, text limit 40)
 select symbol, target, text, sample_type from (select * from o union all select * from r) z order by i, symbol, target, text limit 40""")
def representative_sample(m):
    from foreopen.plans.runs import representative

    pool = m.reddit.select(F.col("sub").alias("symbol"), F.col("created_et").cast("date").alias("target"), F.col("body").alias("text"), "created_et", F.col("turn").alias("ticker_mentions"))
    return representative(pool, 40)


@query(f"""with {PANEL}, w as (select s.symbol, t.target from (select distinct symbol from v_daily) s cross join (select distinct target from panel) t)
 select w.symbol, w.target, coalesce(case when gap_pct is null then 2 else ({label_sql('gap_pct * 5.25')}) end, 2) as label from w left join panel p on p.symbol = w.symbol and p.target = w.target""")
def predict_all(m):
    """The default rule for every symbol and target day; flat where nothing is known."""
    from foreopen.plans.runs import predict

    return predict(m, None)


@query(f"select fold, {r('corr(s, label)')} as rho, count(*) as n from v_pred where s is not null and label is not null group by fold")
def pearson(m):
    return rounded(E.pearson(m.predictions, "s", "label", "fold"))


def _parity(m, groups: list[str], n: int):
    """n target days, each made from its own cut of the tables, against the batch panel: a row a column."""
    from foreopen.operators import features as X
    from foreopen.plans.text_queries import LEXICON, aliases

    text = any(g.startswith("txt") for g in groups)
    build = {"groups": groups} | ({"aliases": aliases(m), "lexicon": LEXICON} if text else {})
    order = E.draw(F.lit("parity"), F.col("target").cast("string"))
    days = [r["target"] for r in m.calendar.where("target is not null").orderBy(order, "target").limit(n).collect()]
    whole, own = X.build_features(m, **build).where(F.col("target").isin(days)), None
    for d in days:
        x = X.day_features(m, d, **build)
        own = x if own is None else own.unionByName(x)
    if "txt_text" in groups:  # equal texts have equal codes
        code = F.xxhash64("titles_r1").bitwiseAND((1 << 40) - 1).cast("double")
        whole, own = whole.withColumn("titles_r1", code), own.withColumn("titles_r1", code)
    return E.parity(whole, own, X.resolve(["core", *groups]))


_SAME = ("core", "scale", "cross", "event", "analyst", "news", "regime")


@query(None)
def parity_all(m):
    """Eight days of every group but text: rows compared, nulls that differ, the largest difference, rows beyond 1e-9."""
    return _parity(m, list(_SAME), 8)


@query(None)
def parity_text(m):
    """Two days of the text groups (a day is a plan of its own, and theirs are long)."""
    from foreopen.operators.features import GROUPS

    return _parity(m, [g for g in GROUPS if g.startswith("txt")], 2)
