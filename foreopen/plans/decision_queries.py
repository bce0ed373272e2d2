"""Scores, rules, regimes and learned signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreopen.operators import decisions as D
from foreopen.operators import experiments as E
from foreopen.plans.market_queries import PANEL, label_sql, labelled
from foreopen.plans.registry import query, r, rounded, score_ctes

_OBS = "select {0}label as y, pred as q, 1 as o from v_pred"


@query(f"with o as ({_OBS.format('fold, draw, ')}), {score_ctes('o', 'fold, draw')} select fold, draw, n, {r('score')} as score from scored")
def score_by_unit(m):
    return rounded(D.score_counts(D.counts(m.predictions, "fold", "draw"), "fold", "draw").withColumn("n", F.col("n").cast("long")))


_SHARE = lambda hit, of="true": r(f"count(*) filter (({hit}) and {of})::double / nullif(count(*) filter ({of}), 0)")


@query(f"""with o as ({_OBS.format('fold, ')}), {score_ctes('o', 'fold')}, a as (select fold, {_SHARE('label = pred')} as accuracy, {_SHARE('sign(label - 2) = sign(pred - 2)', 'label <> 2')} as direction,
 {_SHARE('label = pred', 'label in (0, 4)')} as big_recall, {_SHARE('label = pred', 'pred in (0, 4)')} as big_prec from v_pred group by fold)
 select s.fold, s.n, {r('s.score')} as score, accuracy, direction, big_recall, big_prec from scored s join a on a.fold = s.fold""")
def score_core(m):
    return rounded(D.score(m.predictions, "fold").withColumn("n", F.col("n").cast("long")))


_W = "((label - pred) * (label - pred) * (label - 2) * (label - 2))"
_FLIP = "((label = 0 and pred = 4) or (label = 4 and pred = 0))"
_MORE = f"""m as (select fold, avg((abs(label - 2) = abs(pred - 2))::int::double) as magnitude_acc, avg({_FLIP}::int::double) as flip_index,
 coalesce(avg((pred = 4)::int::double) filter (label = 0), 0) + coalesce(avg((pred = 0)::int::double) filter (label = 4), 0) as flip_rate,
 coalesce(sum({_W}) filter ({_FLIP}), 0)::double / nullif(sum({_W}), 0) as flip_loss_share, avg((pred in (0, 4))::int::double) as pred_extreme, avg((label in (0, 4))::int::double) as true_extreme,
 {', '.join(f'coalesce(sum({_W}) filter (label = {i}), 0)::double / nullif(sum({_W}), 0) as l{i}' for i in range(5))} from v_pred group by fold)"""
_MORE_COLS = ["magnitude_acc", "flip_index", "flip_rate", "flip_loss_share", "pred_extreme", "true_extreme"]


@query(f"with {_MORE} select fold, {', '.join(f'{r(c)} as {c}' for c in _MORE_COLS)} from m")
def score_extended(m):
    return rounded(D.score_more(m.predictions, "fold").select("fold", *_MORE_COLS))


@query(f"with {_MORE}, o as ({_OBS.format('fold, ')}), {score_ctes('o', 'fold')} select m.fold, {', '.join(f'{r(f'l{i} * (1 - score)')} as loss_c{i}' for i in range(5))} from m join scored s on s.fold = m.fold")
def score_loss_by_class(m):
    return rounded(D.score_more(m.predictions, "fold").select("fold", *[f"loss_c{i}" for i in range(5)]))


@query(f"""with o as (select fold, draw, 'all' as scope, label as y, pred as q, 1 as o from v_pred union all select fold, draw, case when seen then 'seen' else 'unseen' end, label, pred, 1 from v_pred),
 {score_ctes('o', 'fold, draw, scope')} select fold, draw, scope, n, {r('score')} as score from scored""")
def score_by_scope(m):
    return rounded(E.by_scope(m.predictions, "fold", "draw").withColumn("n", F.col("n").cast("long")))


@query("select event_id, case when s < -2.5 then 0 when s < -0.6 then 1 when s < 0.6 then 2 when s < 2.5 then 3 else 4 end as pred from v_pred")
def rule_identity(m):
    return m.predictions.select("event_id", D.by_bounds(F.col("s"), D.CUTS).alias("pred"))


_KGRID = "kg as (select i, 0.5 + i * 0.25 as k from range(31) t(i))"


@query(f"""with {PANEL}, {_KGRID}, o as (select i, k, label as y, coalesce({label_sql('gap_pct * k')}, 2) as q, 1 as o from labelled cross join kg), {score_ctes('o', 'i, k')}
 select i, {r('k')} as k, n, {r('score')} as score from scored""")
def rule_k_grid(m):
    return rounded(D.fit_k(labelled(m), signal="gap_pct")[0].withColumn("n", F.col("n").cast("long")).select("i", "k", "n", "score"))


@query(f"""with {PANEL}, {_KGRID}, o as (select i, k, label as y, coalesce({label_sql('gap_pct * k')}, 2) as q, 1 as o from labelled cross join kg), {score_ctes('o', 'i, k')}
 select i, {r('k')} as k, {r('score')} as score from scored order by score desc nulls last, i limit 1""")
def rule_k_best(m):
    return rounded(D.fit_k(labelled(m), signal="gap_pct")[1].select("i", "k", "score"))


@query(f"""with kg as (select i, 0.5 + i * 1.5 as k from range(6) t(i)), g as (select a.i as iu, b.i as idn, a.k as k_up, b.k as k_dn from kg a cross join kg b),
 o as (select iu, idn, k_up, k_dn, label as y, case when s >= 0 then {label_sql('s * k_up')} else {label_sql('s * k_dn')} end as q, 1 as o from v_pred cross join g), {score_ctes('o', 'iu, idn, k_up, k_dn')}
 select {r('k_up')} as k_up, {r('k_dn')} as k_dn, {r('score')} as score from scored order by score desc nulls last, iu, idn limit 1""")
def rule_asym(m):
    return rounded(D.fit_asym(m.predictions, "s", low=0.5, high=8.0, step=1.5).select("k_up", "k_dn", "score"))


_LEVELS = ", ".join(str(round(0.05 + 0.03 * i, 3)) for i in range(32))


@query(f"""with c as (select unnest(quantile_cont(abs(s), [{_LEVELS}])) as a from v_pred), d as (select a, row_number() over (order by a) - 1 as i from (select distinct a from c) z),
 g as (select x.i, y.i as j, x.a, y.a as b from d x join d y on x.i < y.i),
 o as (select i, j, a, b, label as y, ((s >= -b)::int + (s >= -a)::int + (s >= a)::int + (s >= b)::int) as q, 1 as o from v_pred cross join g), {score_ctes('o', 'i, j, a, b')}
 select {r('a')} as a, {r('b')} as b, {r('score')} as score from scored order by score desc nulls last, i, j limit 1""")
def rule_sym2(m):
    return rounded(D.fit_sym2(m.predictions, "s").select("a", "b", "score"))


@query(None)
def rule_four(m):
    """Four free bounds (coordinate descent has no SQL)."""
    b = D.fit_four(m.predictions, "s")
    return m.spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(b)], "i int, bound double")


@query(f"with {PANEL}, o as (select label as y, coalesce({label_sql('gap_pct * 5.25')}, 2) as q, 1 as o from labelled), {score_ctes('o', '')} select n, {r('score')} as score from scored")
def gap_rule_score(m):
    return rounded(D.score_counts(D.counts(D.gap_rule(labelled(m)))).withColumn("n", F.col("n").cast("long")))


_R = "rg as (select p.*, g.rv from v_pred p join (select target, avg(s) as rv from v_pred group by target) g on g.target = p.target)"


def _with_regime(m):
    return m.predictions.join(m.predictions.groupBy("target").agg(F.avg("s").alias("rv")), "target")


@query(f"""with {_R}, e as (select quantile_cont(rv, 1.0 / 3) as e1, quantile_cont(rv, 2.0 / 3) as e2 from (select distinct target, rv from rg) z),
 g as (select a.i, b.i as j, round(0.6 + a.i * 0.1, 3) as f_lo, round(0.6 + b.i * 0.1, 3) as f_hi from range(11) a(i) cross join range(11) b(i)),
 o as (select i, j, f_lo, f_hi, label as y, {label_sql('s * 1.0 * (case when rv < e1 then f_lo when rv < e2 then 1.0 else f_hi end)')} as q, 1 as o from rg cross join e cross join g), {score_ctes('o', 'i, j, f_lo, f_hi')}
 select {r('f_lo')} as f_lo, {r('f_hi')} as f_hi, {r('score')} as score, {r('(select e1 from e)')} as e1, {r('(select e2 from e)')} as e2 from scored order by score desc nulls last, i, j limit 1""")
def regime_tercile(m):
    return rounded(D.fit_tercile(_with_regime(m), "rv", 1.0).select("f_lo", "f_hi", "score", "e1", "e2"))


@query(f"""with {_R}, e as (select median(rv) as med, quantile_cont(rv, 0.75) - quantile_cont(rv, 0.25) as iqr from (select distinct target, rv from rg) z), g as (select i, round(-1.0 + i * 0.1, 3) as a from range(21) t(i)),
 o as (select i, a, label as y, {label_sql('s * greatest(least(exp(a * (rv - med) / iqr), 2.0), 0.5)')} as q, 1 as o from rg cross join e cross join g), {score_ctes('o', 'i, a')}
 select {r('a')} as a, {r('score')} as score from scored order by score desc nulls last, i limit 1""")
def regime_linear(m):
    return rounded(D.fit_linear(_with_regime(m), "rv", 1.0).select("a", "score"))


_CHUNK = f"t as (select target, ntile(3) over (order by target) as chunk from (select distinct target from v_pred) z), o as (select chunk, label as y, pred as q, 1 as o from v_pred p join t on t.target = p.target), {score_ctes('o', 'chunk')}"


@query(f"with {_CHUNK} select 'mean' as kind, {r('avg(score)')} as score from scored union all select 'mean_sd', {r('avg(score) - stddev_pop(score)')} from scored union all select 'min', {r('min(score)')} from scored")
def objective_chunks(m):
    parts = [D.objective(m.predictions, 3, k).select(F.lit(k).alias("kind"), "score") for k in ("mean", "mean_sd", "min")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


_STRAT = {"flat": "2", "surge": "4", "direction": "case when label < 2 then 1 when label > 2 then 3 else 2 end", "extremes": "case when label in (0, 4) then label else 2 end", "flipped": "case when label in (0, 4) then 4 - label else 2 end", "perfect": "label"}


@query("with o as (" + " union all ".join(f"select '{k}' as strategy, label as y, {v} as q, 1 as o from v_pred" for k, v in _STRAT.items()) + f"), {score_ctes('o', 'strategy')} select strategy, n, {r('score')} as score from scored")
def baseline_strategies(m):
    return rounded(D.baselines(m.predictions).withColumn("n", F.col("n").cast("long")))


@query(f"""with h as (select share, label as y, case when label in (0, 4) then label when label = 2 and ('0x' || substr(md5(event_id::varchar), 1, 8))::bigint / 4294967296.0 < share then 4 else 2 end as q, 1 as o
 from v_pred cross join (values (0.0), (0.05), (0.1), (0.2), (0.4)) s(share)), {score_ctes('h', 'share')} select {r('share')} as share, {r('score')} as score from scored""")
def flat_row_effect(m):
    return rounded(D.flat_rows(m.predictions))


_P = [f"embedding[{i + 4}] * embedding[{i + 4}]" for i in range(5)]
_COST = lambda j: " + ".join(f"({p}) * {(i - j) ** 2 * (i - 2) ** 2}.0" for i, p in enumerate(_P))


@query(f"select vec_id, list_position(c, list_min(c))::int - 1 as pred from (select vec_id, [{', '.join(_COST(j) for j in range(5))}] as c from (select vec_id, embedding::double[] as embedding from embeddings) a) b")
def cost_min_predict(m):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return m.raw("embeddings").select("vec_id", D.cost_min([e(i + 3) * e(i + 3) for i in range(5)]).alias("pred"))


def _learned(m, spec):
    p = labelled(m).cache()
    return D.Pipeline(spec).fit(p).predict(p).select("symbol", "target", "label", "pred")


@query(None)
def gbt_signal(m):
    """Boosted regression on the panel, then a factor (trees have no SQL)."""
    return _learned(m, D.Spec("regress", "regress", "k", features=("gap_pct", "gap_rank", "vol5", "mkt_gap", "resid_gap")))


@query(None)
def forest_labels(m):
    """Five-class forest, expected return, two thresholds."""
    return _learned(m, D.Spec("forest", "classify5", "sym2", features=("gap_pct", "gap_rank", "vol5", "mkt_gap")))


@query(None)
def decomposed_signal(m):
    """Move, extreme and direction heads with their thresholds."""
    return _learned(m, D.Spec("decomp", "decomp", "decomp", features=("gap_pct", "gap_rank", "vol5"), params={"trees": 5}))


@query(None)
def text_clf(m):
    """Probability of a big move from headlines: balanced logistic regression over weighted words."""
    from foreopen.plans.text_queries import titled

    x = titled(m).cache()
    return D.BigMove({"min_df": 2}).fit(x).values(x).select("symbol", "target", F.col(D.BIG).alias("p_big"))


@query(None)
def regime_text(m):
    """The gap rule, its size scaled by the third in which the headlines' probability of a big move lies."""
    from foreopen.plans.text_queries import titled

    x = titled(m).cache()
    spec = D.Spec("text", "column", "k", "textclf", params={"vectorizer": "count_uni", "min_df": 2}, tune_share=0.4)
    return D.Pipeline(spec).fit(x).predict(x).select("symbol", "target", "label", "s", "pred")


@query(None)
def text_terms(m):
    """The twenty terms that speak most for a big move and the twenty that speak most against it."""
    from foreopen.plans.text_queries import titled

    terms = D.BigMove({"min_df": 2}).fit(titled(m).cache()).terms()
    return m.spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(terms)], "rank int, term string, coefficient double")
