"""News: keys, flags, relevance, stories, tone and novelty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreopen.functions import text as T
from foreopen.operators import features as X
from foreopen.plans.market_queries import NINE
from foreopen.plans.registry import query, r, rounded

#: Companies' names for the synthetic headlines: frequent words, so that titles name none, one or several.
NAMES = "The Of And Is To In De Le La En Der Die Und Ou Es El On With For That".split()
ALIASES = {f"T{'AB'[i // 10]}{'ABCDEFGHIJ'[i % 10]}": name for i, name in enumerate(NAMES)}
LEXICON = {"positive": ["THE", "AND", "LE", "DER"], "negative": ["OF", "TO", "LA", "DIE"], "uncertainty": ["IS", "IN", "ON", "EN"]}


def pattern(name: str) -> str:
    return f"(^|[^A-Za-z]){name}([^A-Za-z]|$)"


def aliases(m) -> DataFrame:
    return m.spark.createDataFrame([(t, n.lower(), pattern(n)) for t, n in ALIASES.items()], "ticker string, word string, pattern string")


def symbols(m) -> DataFrame:
    return m.daily.select("symbol").distinct()


_VALUES = "alias(ticker, pattern) as (values " + ", ".join(f"('{t}', '{pattern(n)}')" for t, n in ALIASES.items()) + ")"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_CLEAN = r"trim(regexp_replace(coalesce(title, ''), '\s+[-|–—]\s+[^-|–—]{1,40}$', ''))"
_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_CKEY = f"md5(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower({{0}}), '[a-z][a-z''&-]+'), lambda x: x not in ({_STOP})))), ' '))"
_ART = f"""sym as (select distinct symbol from v_daily), {_VALUES},
win as (select distinct target from v_calendar where target is not null), widx as (select target, row_number() over (order by target) - 1 as widx from win),
n0 as (select n.doc_id, n.known_at, n.source, n.tone, {_CLEAN} as title, unnest(string_split(n.symbols, ',')) as symbol from v_news n),
n1 as (select n0.*, c.target, w.widx from n0 join sym on sym.symbol = n0.symbol join v_calendar c on c.target is not null and n0.known_at >= c.date::timestamp + {NINE} and n0.known_at < c.target::timestamp + {NINE} join widx w on w.target = c.target),
hit as (select distinct t.title, a.ticker from (select distinct title from n1) t join alias a on regexp_matches(t.title, a.pattern)),
cnt as (select title, count(*) as k from hit group by title),
art as (select n1.*, md5({_NORM.format('n1.title')}) as title_id, {_CKEY.format('n1.title')} as ckey, regexp_matches(n1.title, '(?i){T.TEMPLATE.replace("'", "''")}')::int as is_template,
 case when h.ticker is null then 0 when c.k <= 1 then 2 else 1 end as rel, case when h.ticker is null then 0 else c.k end::int as n_entities
 from n1 left join hit h on h.title = n1.title and h.ticker = n1.symbol left join cnt c on c.title = n1.title),
clu as (select symbol, widx, target, ckey, max(rel) as rel from art where is_template = 0 group by symbol, widx, target, ckey),
clus as (select c.*, not exists (select 1 from clu p where p.symbol = c.symbol and p.ckey = c.ckey and p.widx < c.widx and p.widx >= c.widx - 5) as is_first from clu c),
reps as (select symbol, widx, target, ckey, min_by(title, struct_pack(a := known_at, b := title_id, c := doc_id)) as title, min(known_at) as known_at, avg(tone) as tone from art where is_template = 0 and rel >= 1 group by symbol, widx, target, ckey)"""


def rows(m):
    return X.articles(m.news, m.calendar, symbols(m), aliases(m))


@query(f"with {_ART} select doc_id, symbol, target, widx, title_id, ckey, is_template, rel, n_entities from art")
def text_articles(m):
    return rows(m).select("doc_id", "symbol", "target", F.col("widx").cast("long").alias("widx"), "title_id", "ckey", "is_template", "rel", "n_entities")


@query(f"with {_ART} select doc_id, symbol, rel from art")
def relevance_levels(m):
    return rows(m).select("doc_id", "symbol", "rel")


@query(f"with {_ART} select n_entities, count(*) as n from art group by n_entities")
def entity_count(m):
    return rows(m).groupBy("n_entities").agg(F.count("*").alias("n"))


@query(f"select doc_id, md5({_NORM.format('title')}) as title_id from v_news")
def title_ids(m):
    return m.news.select("doc_id", T.title_id(F.col("title")).alias("title_id"))


@query(f"select doc_id, {_CKEY.format('title')} as ckey from v_news")
def title_cluster(m):
    return m.news.select("doc_id", T.cluster_key(F.col("title")).alias("ckey"))


@query(f"with {_ART} select symbol, target, ckey, rel, is_first from clus")
def first_story(m):
    return X.first_clusters(rows(m)).select("symbol", "target", "ckey", "rel", "is_first")


@query(f"with {_ART} select symbol, target, ckey, title, known_at, {r('tone')} as tone from reps")
def cluster_rep(m):
    return rounded(X.representatives(rows(m)).select("symbol", "target", "ckey", "title", "known_at", "tone"))


@query(f"with {_ART} select symbol, target, string_agg(title, ' || ' order by known_at, ckey, title) as titles from reps group by symbol, target")
def titles_join(m):
    parts = F.array_sort(F.collect_list(F.struct("known_at", "ckey", "title")))
    return X.representatives(rows(m)).groupBy("symbol", "target").agg(F.array_join(F.transform(parts, lambda x: x["title"]), " || ").alias("titles"))


_DEDUP = f"""sym as (select distinct symbol from v_daily), n0 as (select n.doc_id, n.known_at, n.tone, n.title, unnest(string_split(n.symbols, ',')) as symbol from v_news n),
n1 as (select n0.symbol, c.target, md5({_NORM.format('n0.title')}) as id, min_by(tone, struct_pack(a := known_at, b := doc_id)) as tone from n0 join sym on sym.symbol = n0.symbol
 join v_calendar c on c.target is not null and n0.known_at >= c.date::timestamp + {NINE} and n0.known_at < c.target::timestamp + {NINE} group by n0.symbol, c.target, md5({_NORM.format('n0.title')})),
nb as (select g.symbol, g.target, coalesce(n.news_n, 0)::double as news_n, n.tone_mean, n.tone_min, n.tone_max, coalesce(n.tone_neg_tail, 0)::double as tone_neg_tail
 from (select s.symbol, c.target from sym s cross join (select distinct target from v_calendar where target is not null) c) g
 left join (select symbol, target, count(*) as news_n, avg(tone) as tone_mean, min(tone) as tone_min, max(tone) as tone_max, count(*) filter (tone < -5) as tone_neg_tail from n1 group by symbol, target) n on n.symbol = g.symbol and n.target = g.target),
nw as (select *, ln(1 + news_n) - ln(1 + case when count(news_n) over p >= 20 then avg(news_n) over p end) as news_abn, (sum(news_n) over q = 0 and count(news_n) over q = 21)::int::double as news_missing
 from nb window p as (partition by symbol order by target rows between 20 preceding and 1 preceding), q as (partition by symbol order by target rows between 20 preceding and current row))"""


@query(f"with {_DEDUP} select symbol, target, id, {r('tone')} as tone from n1")
def news_dedup(m):
    from foreopen.operators.asof import to_target

    n = to_target(T.explode_symbols(m.news).join(symbols(m), "symbol"), m.calendar).withColumn("id", T.title_id(F.col("title")))
    return rounded(n.groupBy("symbol", "target", "id").agg(F.min_by("tone", F.struct("known_at", "doc_id")).alias("tone")))


@query(f"with {_DEDUP} select symbol, target, {', '.join(f'{r(c)} as {c}' for c in ('news_n', 'tone_mean', 'tone_min', 'tone_max', 'tone_neg_tail'))} from nw")
def news_block(m):
    return rounded(X.news_block(m.news, m.calendar, symbols(m)).select("symbol", "target", "news_n", "tone_mean", "tone_min", "tone_max", "tone_neg_tail"))


@query(f"with {_DEDUP} select symbol, target, {r('news_abn')} as news_abn from nw")
def news_abn(m):
    return rounded(X.news_block(m.news, m.calendar, symbols(m)).select("symbol", "target", "news_abn"))


@query(f"with {_DEDUP} select symbol, target, news_missing from nw")
def news_missing(m):
    return X.news_block(m.news, m.calendar, symbols(m)).select("symbol", "target", "news_missing")


@query(f"select doc_id, regexp_matches(coalesce(title, ''), '(?i){T.TEMPLATE}')::int as is_template from v_news")
def template_flag(m):
    return m.news.select("doc_id", T.is_template(F.col("title")).alias("is_template"))


@query("select doc_id, " + ", ".join(f"regexp_matches(lower(coalesce(title, '')), '{p}')::int as ev_{e}" for e, p in T.EVENTS.items()) + " from v_news")
def event_flags(m):
    return m.news.select("doc_id", *[c.alias(n) for n, c in T.event_flags(F.col("title")).items()])


def _in(words, x: str = "x") -> str:
    return f"{x} in ({', '.join(repr(w) for w in words)})"


_NEG = [w.upper() for w in T.NEGATORS]
_LM = f"""w0 as (select doc_id, list_transform(regexp_extract_all(coalesce(title, ''), '[A-Za-z]+'), lambda x: upper(x)) as ws from v_news),
w1 as (select doc_id, len(ws) as n, ws, unnest(ws) as x, generate_subscripts(ws, 1) as i from w0),
w2 as (select *, len(list_filter(ws[greatest(i - 3, 1):i - 1], lambda v: {_in(_NEG, 'v')})) > 0 as no from w1),
lm as (select doc_id, (count(*) filter ({_in(LEXICON['positive'])} and not no) - count(*) filter (({_in(LEXICON['positive'])} and no) or {_in(LEXICON['negative'])}))::double / max(n) as net,
 (count(*) filter ({_in(LEXICON['uncertainty'])}))::double / max(n) as unc from w2 group by doc_id)"""


@query(f"with {_LM} select v.doc_id, {r('net')} as lm_net, {r('unc')} as lm_unc from v_news v left join lm on lm.doc_id = v.doc_id")
def lm_scores(m):
    net, unc = T.lexicon_scores(F.col("title"), **{"positive": LEXICON["positive"], "negative": LEXICON["negative"], "uncertain": LEXICON["uncertainty"]})
    return rounded(m.news.select("doc_id", net.alias("lm_net"), unc.alias("lm_unc")))


_NOV = f"""{_ART}, tok as (select symbol, widx, target, ckey, unnest(list_filter(regexp_extract_all(regexp_replace(lower(title), '[\\pL\\pN_]*[^\\x00-\\x7F\\PL][\\pL\\pN_]*', '_', 'g'), '\\b[a-z][a-z''&-]+\\b'), lambda x: x not in ({_STOP}))) as word from reps),
tf as (select symbol, widx, ckey, word, count(*)::double as n from tok group by symbol, widx, ckey, word), ln as (select symbol, widx, ckey, sqrt(sum(n * n)) as l from tf group by symbol, widx, ckey),
tw as (select tf.symbol, tf.widx, tf.ckey, word, n / l as w from tf join ln on ln.symbol = tf.symbol and ln.widx = tf.widx and ln.ckey = tf.ckey),
sims as (select a.symbol, a.widx, a.ckey, b.widx as w0, b.ckey as c0, sum(a.w * b.w) as cos from tw a join tw b on a.symbol = b.symbol and a.word = b.word and b.widx < a.widx and b.widx >= a.widx - 20 group by a.symbol, a.widx, a.ckey, b.widx, b.ckey),
best as (select symbol, widx, ckey, max(cos) as cos from sims group by symbol, widx, ckey),
nov as (select p.symbol, p.widx, p.target, max(1 - coalesce(b.cos, 0)) as novelty from reps p left join best b on b.symbol = p.symbol and b.widx = p.widx and b.ckey = p.ckey group by p.symbol, p.widx, p.target)"""


@query(f"with {_NOV} select symbol, widx, {r('novelty')} as novelty from nov")
def novelty_cosine(m):
    return rounded(X.novelty(X.representatives(rows(m))).select("symbol", F.col("widx").cast("long").alias("widx"), "novelty"))


_COUNTS = [f"n_{k}_r{i}" for k in ("clu", "first") for i in (0, 1, 2)]
_CNT = ", ".join([f"count(*) filter (rel >= {i})::double as n_clu_r{i}" for i in (0, 1, 2)] + [f"count(*) filter (rel >= {i} and is_first)::double as n_first_r{i}" for i in (0, 1, 2)])
_EV = ", ".join(f"max(regexp_matches(lower(title), '{p}')::int)::double as ev_{e}_r1" for e, p in T.EVENTS.items())
_TB = f"""{_NOV}, grid as (select s.symbol, w.target from sym s cross join win w), cc as (select symbol, target, {_CNT} from clus group by symbol, target),
g as (select grid.symbol, grid.target, {', '.join(f'coalesce({c}, 0)::double as {c}' for c in _COUNTS)} from grid left join cc on cc.symbol = grid.symbol and cc.target = grid.target),
ga as (select *, {', '.join(f'ln(1 + {c}) - ln(1 + case when count({c}) over p >= 20 then avg({c}) over p end) as {c}_abn' for c in _COUNTS)} from g window p as (partition by symbol order by target rows between 20 preceding and 1 preceding)),
sh as (select symbol, target, avg(is_template) as tmpl_share_r0 from art group by symbol, target), sr as (select symbol, target, count(distinct source)::double as n_src_r1 from art where is_template = 0 and rel >= 1 group by symbol, target),
ag as (select symbol, target, avg(tone) as tone_mean_r1, avg((tone < 0)::int::double) as tone_neg_share_r1, stddev_samp(tone) as tone_sd_r1, count(*)::double as n_scored_r1, string_agg(title, ' || ' order by known_at, ckey, title) as titles_r1, {_EV} from reps group by symbol, target)"""
_OUT = [*_COUNTS, *[f"{c}_abn" for c in _COUNTS], "tmpl_share_r0", "n_src_r1", "tone_mean_r1", "tone_neg_share_r1", "tone_sd_r1", "n_scored_r1", "novelty_r1", *[f"ev_{e}_r1" for e in T.EVENTS], "ev_any_r1"]
_EXPR = {"n_src_r1": "coalesce(n_src_r1, 0)", "n_scored_r1": "coalesce(n_scored_r1, 0)", "novelty_r1": "nov.novelty", "ev_any_r1": f"greatest({', '.join(f'ev_{e}_r1' for e in T.EVENTS)})"}


@query(f"""with {_TB} select ga.symbol, ga.target, coalesce(titles_r1, '') as titles_r1, {', '.join(f'{r(_EXPR.get(c, c))} as {c}' for c in _OUT)} from ga
 left join sh on sh.symbol = ga.symbol and sh.target = ga.target left join sr on sr.symbol = ga.symbol and sr.target = ga.target
 left join ag on ag.symbol = ga.symbol and ag.target = ga.target left join nov on nov.symbol = ga.symbol and nov.target = ga.target""")
def text_features(m):
    return rounded(X.text_block(m.news, m.calendar, symbols(m), aliases(m)).select("symbol", "target", "titles_r1", *_OUT))


def titled(m) -> DataFrame:
    """The labelled panel with each target's joined titles."""
    from foreopen.plans.market_queries import labelled

    parts = F.array_sort(F.collect_list(F.struct("known_at", "ckey", "title")))
    got = X.representatives(rows(m)).groupBy("symbol", "target").agg(F.array_join(F.transform(parts, lambda x: x["title"]), " || ").alias("titles_r1"))
    return labelled(m).join(got, ["symbol", "target"], "left").fillna("", ["titles_r1"])


#: Words of the lexicon that headlines are counted by.
WORDS = sorted({w for kind in LEXICON.values() for w in kind})


def _vectors(m, kind: str) -> DataFrame:
    base = m.news.select("doc_id", "title")
    return T.Vectorizer(kind, lexicon=WORDS).fit(base).transform(base)


@query(None)
def text_vectors(m):
    """Each of the eight vectorizers on headlines: terms kept a title, and its vector's length (1 but for counts)."""
    norm = F.udf(lambda v: float(v.norm(2)), "double")
    size = F.udf(lambda v: int(v.numNonzeros()), "int")
    out = None
    for kind in T.VECTORIZERS:
        x = _vectors(m, kind).select("doc_id", F.lit(kind).alias("kind"), size("features").alias("terms"), norm("features").alias("norm"))
        out = x if out is None else out.unionByName(x)
    return out


_TOKEN = T.VEC_TOKEN.replace("'", "''")
_TERMS = f"""tok as (select doc_id, regexp_extract_all(lower(coalesce(title, '')), '{_TOKEN}') as w, (select count(*) from v_news) as n from v_news),
long as (select 'uni' as g, doc_id, unnest(w) as t from tok union all select 'bi', doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) from tok),
df as (select g, t, count(distinct doc_id) as df from long group by g, t), kept as (select l.g, l.doc_id, l.t, count(*) as c, max(d.df) as df from long l join df d on d.g = l.g and d.t = l.t group by l.g, l.doc_id, l.t),
kinds as (select 'count_uni' as kind, doc_id, c from kept where g = 'uni' and df >= 5 union all select 'tfidf_uni', doc_id, c from kept where g = 'uni' and df >= 5
 union all select 'tfidf_bi', doc_id, c from kept where g = 'bi' and df >= 5 union all select 'tfidf_stop', doc_id, c from kept where g = 'uni' and df >= 5 and t not in ({', '.join(f"'{w}'" for w in T.STOPWORDS if w not in T.NEGATORS)})
 union all select 'tfidf_df', doc_id, c from kept where g = 'uni' and df >= 20 and df <= 0.5 * (select count(*) from v_news) union all select 'lm_vocab', doc_id, c from kept where g = 'uni' and t in ({', '.join(f"'{w.lower()}'" for w in WORDS)}))"""


@query(f"""with {_TERMS} select v.doc_id, k.kind, coalesce(x.terms, 0) as terms from v_news v cross join (values ('count_uni'), ('tfidf_uni'), ('tfidf_bi'), ('tfidf_stop'), ('tfidf_df'), ('lm_vocab')) k(kind)
 left join (select kind, doc_id, count(*) as terms from kinds group by kind, doc_id) x on x.kind = k.kind and x.doc_id = v.doc_id""")
def vector_terms(m):
    """How many terms of each title the vectorizers keep."""
    return text_vectors_of(m).select("doc_id", "kind", F.col("terms").cast("long").alias("terms"))


def text_vectors_of(m) -> DataFrame:
    size = F.udf(lambda v: int(v.numNonzeros()), "int")
    out = None
    for kind in ("count_uni", "tfidf_uni", "tfidf_bi", "tfidf_stop", "tfidf_df", "lm_vocab"):
        x = _vectors(m, kind).select("doc_id", F.lit(kind).alias("kind"), size("features").alias("terms"))
        out = x if out is None else out.unionByName(x)
    return out
