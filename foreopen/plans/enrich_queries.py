"""Social activity, title scores, request queue, and the batch forms of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreopen.functions import series as S
from foreopen.functions import text as T
from foreopen.operators import enrich as N
from foreopen.plans.market_queries import NINE
from foreopen.plans.registry import query, r, rounded
from foreopen.plans.text_queries import _ART as ARTICLES
from foreopen.plans.text_queries import ALIASES
from foreopen.streaming import windows as W

_COMMON = ", ".join(f"'{w}'" for w in T.COMMON_TICKERS)
_RED = f"""tg as (select distinct date as target from v_calendar), tp as (select target, lag(target) over (order by target) as date from tg),
rw as (select v.*, t.target from v_reddit v join tp t on t.date is not null and v.created_et >= t.date::timestamp + {NINE} and v.created_et < t.target::timestamp + {NINE}),
me as (select conv_id, turn, sub, target, unnest(list_distinct(list_concat(list_transform(regexp_extract_all(body, '\\$([A-Za-z]{{1,5}}(?:[./-][A-Za-z])?)\\b', 1), lambda x: regexp_replace(upper(x), '[./]', '-', 'g')),
 list_filter(list_transform(regexp_extract_all(body, '\\b([A-Z]{{3,5}}(?:[./-][A-Z])?)\\b', 1), lambda x: regexp_replace(upper(x), '[./]', '-', 'g')), lambda x: x not in ({_COMMON}))))) as symbol from rw),
mn as (select symbol, target, sub, count(*) as mentions from me where symbol in (select distinct symbol from v_daily) group by symbol, target, sub)"""


def targets(m):
    return m.calendar.select(F.col("date").alias("target")).distinct()


def symbols(m):
    return m.daily.select("symbol").distinct()


@query(f"with {_RED} select symbol, target, sub, mentions from mn")
def reddit_mentions(m):
    return N.reddit_mentions(m.reddit, symbols(m), targets(m))


@query(f"with {_RED} select target, sub, count(*) as n from rw group by target, sub")
def reddit_activity(m):
    return N.reddit_activity(m.reddit, targets(m))


@query(f"with {_RED} select target, " + ", ".join(f"count(*) filter (sub = 'sub{i}') as sub{i}" for i in range(8)) + " from rw group by target")
def activity_pivot(m):
    return N.activity_pivot(N.reddit_activity(m.reddit, targets(m)), [f"sub{i}" for i in range(8)])


@query(f"""with recursive {_RED}, gr as (select s.symbol, t.target, coalesce(sum(mentions), 0)::double as x, row_number() over (partition by s.symbol order by t.target) - 1 as i
 from (select distinct symbol from v_daily) s cross join tg t left join mn on mn.symbol = s.symbol and mn.target = t.target group by s.symbol, t.target),
 f as (select symbol, i, x::double as s from gr where i = 0 union all select g.symbol, g.i, {S.span_to_alpha(20)!r} * g.x + {1 - S.span_to_alpha(20)!r} * f.s from f join gr g on g.symbol = f.symbol and g.i = f.i + 1)
 select g.symbol, g.target, {r('g.x')} as mentions, {r('ln(1 + g.x) - ln(1 + f.s)')} as abn from gr g left join f on f.symbol = g.symbol and f.i = g.i - 1""")
def abnormal_ewm(m):
    return rounded(N.abnormal_ewm(N.reddit_mentions(m.reddit, symbols(m), targets(m)), symbols(m), targets(m)).select("symbol", "target", "mentions", "abn"))


@query(f"""with {_RED}, ac as (select target, sub, count(*) as n from rw group by target, sub), rl as (select target, sub, n / avg(n) over (partition by sub) as relative from ac)
 select target, sub, {r('relative')} as relative, {r('avg(relative) over (partition by sub order by target rows between 4 preceding and current row)')} as smooth from rl""")
def relative_activity(m):
    return rounded(N.relative_activity(N.reddit_activity(m.reddit, targets(m))))


@query(f"""with c as (select s.symbol, n.known_at::date as day, count(*) as n from (select doc_id, known_at, unnest(string_split(symbols, ',')) as symbol from v_news) n join (select distinct symbol from v_daily) s on s.symbol = n.symbol group by s.symbol, n.known_at::date),
 md as (select symbol, median(n) as usual from c group by symbol) select c.symbol, c.day, c.n, {r('c.n / md.usual')} as ratio from c join md on md.symbol = c.symbol""")
def articles_over_median(m):
    """A symbol's articles of a day against its usual number."""
    n = T.explode_symbols(m.news).join(symbols(m), "symbol").groupBy("symbol", F.col("known_at").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return rounded(N.over_median(n, "symbol", "n"))


_TOP = "case when p_pos = greatest(p_pos, p_neg, p_neu) then 'positive' when p_neg = greatest(p_pos, p_neg, p_neu) then 'negative' else 'neutral' end"


@query(f"select vec_id, {_TOP} as top from v_finbert")
def label_argmax(m):
    return m.finbert.select("vec_id", N.top_class(F.col("p_pos"), F.col("p_neg"), F.col("p_neu")).alias("top"))


_FB = "fb as (select concat('S', cast(label as varchar)) as symbol, date '2024-01-01' + (vec_id % 7)::int as target, * from v_finbert)"


def _scored(m):
    return m.finbert.select("title_id", F.concat(F.lit("S"), F.col("label").cast("string")).alias("symbol"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 7).cast("int")).alias("target"))


@query(f"with {_FB} select symbol, target, {r('avg(p_pos - p_neg)')} as fb_net, {r(f'avg(({_TOP} = ' + chr(39) + 'negative' + chr(39) + ')::int::double)')} as fb_neg_share, count(*) as fb_n from fb group by symbol, target")
def finbert_agg(m):
    scores = N.import_scores(m.finbert.select("title_id", "p_pos", "p_neg", "p_neu"))
    return rounded(N.title_features(_scored(m), scores))


@query(None)
def pca_embed(m):
    """Mean principal components (MLlib; signs are free)."""
    return N.title_features(_scored(m), m.finbert.select("title_id", "p_pos", "p_neg", "p_neu", "embedding"), dims=4)


@query(f"select fold, {r('avg((abs(s - round(s, 2)) <= 1e-8 + 1e-5 * abs(round(s, 2)))::int::double)')} as agreement, {r('avg(abs(s - round(s, 2)))')} as mae, count(*) as n from v_pred group by fold")
def agreement_rate(m):
    return rounded(N.agreement(m.predictions.withColumn("t", F.round("s", 2)), "s", "t", "fold"))


@query("""with c as (select symbol, pred, count(*) as n from v_pred group by symbol, pred) select symbol, pred as silver from (select *, row_number() over (partition by symbol order by n desc, pred) as k from c) a where k = 1""")
def majority_vote(m):
    return N.majority(m.predictions, "symbol", "pred").select("symbol", "silver")


@query(f"""with h as (select label, avg((label = pred)::int::double) as recall, count(*) as n from v_pred group by label), p as (select pred, avg((label = pred)::int::double) as precision from v_pred group by pred)
 select coalesce(h.label, p.pred) as class, {r('recall')} as recall, n, {r('precision')} as precision from h full join p on p.pred = h.label""")
def silver_scores(m):
    return rounded(N.silver_eval(m.predictions, "label", "pred"))


@query(f"select fold, {r('avg((year(target) = 2024)::int::double)')} as year_acc, {r('avg((year(target) = 2024 and month(target) = 1 + event_id % 2)::int::double)')} as month_acc, count(*) as n from v_pred group by fold")
def placebo_scores(m):
    x = m.predictions.withColumns({"y": F.lit(2024), "mo": (F.col("event_id") % 2 + 1)})
    return rounded(N.placebo(x, "target", "y", "mo", "fold"))


_HEAD = '{"effort": "low", "model": "none", "prompt_version": "1", "schema": "news"}'
_KEY = f"sha256('{_HEAD}' || chr(10) || coalesce(title, ''))"


@query(f"select distinct {_KEY} as key from v_news where {_KEY} not in (select {_KEY} from v_news where doc_id % 3 = 0)")
def llm_pending(m):
    req = m.news.select(N.request_key("news", F.coalesce("title", F.lit(""))).alias("key"), "title", "doc_id")
    return N.pending(req.drop("doc_id"), req.where("doc_id % 3 = 0").select("key")).select("key")


_JSON = "'{\"earnings_result\": \"' || (['beat', 'miss', 'none'])[(doc_id % 3 + 1)::int] || '\", \"guidance_action\": \"' || (['raise', 'cut'])[(doc_id % 2 + 1)::int] || '\", \"analyst_action\": \"none\", \"severity\": ' || (doc_id % 5)::varchar || ', \"unexpectedness\": 1}'"


@query("""select doc_id::varchar as key, sign((case doc_id % 3 when 0 then 1 when 1 then -1 else 0 end) + (case doc_id % 2 when 0 then 1 else -1 end))::double + 0.0 as sign, (doc_id % 5)::double as severity from v_news""")
def llm_sign_features(m):
    body = F.to_json(
        F.struct(
            F.element_at(F.array(F.lit("beat"), F.lit("miss"), F.lit("none")), (F.col("doc_id") % 3 + 1).cast("int")).alias("earnings_result"),
            F.element_at(F.array(F.lit("raise"), F.lit("cut")), (F.col("doc_id") % 2 + 1).cast("int")).alias("guidance_action"),
            F.lit("none").alias("analyst_action"), (F.col("doc_id") % 5).cast("double").alias("severity"), F.lit(1.0).alias("unexpectedness"),
        )
    )
    rows = m.news.select(F.col("doc_id").cast("string").alias("key"), body.alias("response"))
    return N.news_signs(N.parse(rows, N.NEWS_SCHEMA)).select("key", (F.col("sign") + F.lit(0.0)).alias("sign"), "severity")


_NAMES = {t: [n] for t, n in ALIASES.items()}


def _anon_sql() -> str:
    out = r"regexp_replace(coalesce(title, ''), '\$[A-Za-z]{1,5}(?:[.\-][A-Za-z])?\b', '[COMPANY]', 'g')"
    for n in sorted({x for v in _NAMES.values() for x in v}, key=lambda n: (-len(n), n)):
        # no look-around in RE2: words are set apart by doubled blanks first, so that neighbours do not share one
        out = f"regexp_replace({out}, '(?i)(^|[^A-Za-z0-9_]){n}(?:''s)?($|[^A-Za-z0-9_])', '\\1[COMPANY]\\2', 'g')"
    return out


@query(None)
def anonymize_titles(m):
    """Titles without companies and dates (the pattern needs look-around, which DuckDB's has not)."""
    return m.news.select("doc_id", T.anonymize(F.col("title"), _NAMES).alias("title"))


@query(r"""select conv_id, turn, len(list_filter(regexp_extract_all(body, '\d+'), lambda x: x not in ('1', '2'))) as unknown from v_reddit""")
def unknown_numbers(m):
    plain = F.transform(F.regexp_extract_all("body", F.lit(r"\d+"), F.lit(0)), lambda x: x)
    text = F.array_join(plain, " ")
    return m.reddit.select("conv_id", "turn", F.size(T.unknown_numbers(F.lit("1 and 2"), text)).cast("long").alias("unknown"))


@query(f"select date_trunc('hour', ts) as start, event_type, count(*) as n, {r('sum(value)')} as value from events group by date_trunc('hour', ts), event_type")
def stream_hourly(m):
    return rounded(W.hourly(m.raw("events"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""with a as (select user_id, ts, ts - lag(ts) over (partition by user_id order by ts) as d from events), b as (select *, sum(case when d is null or d > interval '30' minute then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as s from a)
 select user_id, min(ts) as start, max(ts) + interval '30' minute as "end", count(*) as n from b group by user_id, s""")
def stream_session(m):
    return W.sessions(m.raw("events")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("select distinct user_id, event_type, date_trunc('day', ts) as ts from events")
def stream_dedup(m):
    x = W.deduplicated(m.raw("events").select("user_id", "event_type", F.date_trunc("day", "ts").alias("ts")))
    return x.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"select c.target, event_type, count(*) as n from events e join v_calendar c on c.target is not null and e.ts >= c.date::timestamp + {NINE} and e.ts < c.target::timestamp + {NINE} group by c.target, event_type")
def stream_by_target(m):
    return W.by_target(m.raw("events"), m.calendar)


_GRID = f"""gr as (select s.symbol, t.target, coalesce(sum(mentions), 0)::double as x, row_number() over (partition by s.symbol order by t.target) - 1 as i
 from (select distinct symbol from v_daily) s cross join tg t left join mn on mn.symbol = s.symbol and mn.target = t.target group by s.symbol, t.target),
f as (select symbol, i, x::double as s from gr where i = 0 union all select g.symbol, g.i, {S.span_to_alpha(20)!r} * g.x + {1 - S.span_to_alpha(20)!r} * f.s from f join gr g on g.symbol = f.symbol and g.i = f.i + 1),
ab as (select g.symbol, g.target, ln(1 + g.x) - ln(1 + f.s) as abn from gr g left join f on f.symbol = g.symbol and f.i = g.i - 1)"""
_NORM = "md5(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')))"


@query(f"""with recursive {_RED}, {_GRID}, {ARTICLES}, ti as (select title_id, row_number() over (order by title_id) - 1 as vec from (select distinct {_NORM.format("coalesce(title, '')")} as title_id from v_news) z),
 told as (select distinct symbol, target, {_NORM.format('title')} as title_id from reps),
 fb as (select t.symbol, t.target, avg(p_pos - p_neg) as fb_net, avg(({_TOP} = 'negative')::int::double) as fb_neg_share, count(*)::double as fb_n from told t join ti on ti.title_id = t.title_id join v_finbert v on v.vec_id = ti.vec group by t.symbol, t.target)
 select g.symbol, c.target, {r('ab.abn')} as mentions_abn, {r('fb_net')} as fb_net, {r('fb_neg_share')} as fb_neg_share, {r('fb_n')} as fb_n
 from (select symbol, date_et from v_daily) g join v_calendar c on c.date = g.date_et and c.target is not null left join ab on ab.symbol = g.symbol and ab.target = c.target left join fb on fb.symbol = g.symbol and fb.target = c.target""")
def research_panel(m):
    """The panel's keys with social and scored-title features; the n-th title by id has the n-th score."""
    from foreopen.plans.runs import attach_research
    from foreopen.plans.text_queries import aliases

    ids = m.news.select(T.title_id(F.col("title")).alias("title_id")).distinct()
    ids = ids.withColumn("vec_id", F.row_number().over(S.Window.orderBy("title_id")) - 1)
    scores = ids.join(m.finbert.drop("title_id"), "vec_id").select("title_id", "p_pos", "p_neg", "p_neu")
    keys = m.daily.select("symbol", F.col("date_et").alias("date")).join(m.calendar.where("target is not null"), "date").select("symbol", "target")
    return rounded(attach_research(keys, m, ["reddit", "finbert"], aliases(m), scores=scores))
