"""Feature blocks on (symbol, target day), and the panel of them all.

Everything is grouped by symbol or by target day; statistics over a day's symbols are taken within the universe, which
is filtered before any window.
"""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreopen.functions import series as S
from foreopen.functions import text as T
from foreopen.operators.asof import to_target
from foreopen.sources.market import as_of, cutoff, label_of, labels

RELEVANCE = (0, 1, 2)
NEWS_WINDOW = 20
FIRST_LOOKBACK = 5

# Names of the feature groups and their columns.
GROUPS = {
    "core": ["gap_pct", "gap_rank"],
    "scale": ["vol5", "vol20", "atr14", "big_rate60", "zgap"],
    "cross": ["mkt_gap", "resid_gap", "beta60"],
    "event": ["earn", "surp_sign", "surp_abs", "surp_pct_w"],
    "analyst": ["an_n", "an_up", "an_down", "an_tgt_chg", "an_gap_agree"],
    "news": ["news_n", "news_abn", "tone_mean", "tone_min", "tone_max", "tone_neg_tail", "news_missing"],
    "regime": ["reg_med_vol20", "reg_med_absgap", "reg_gap_disp", "reg_mkt_gap", "reg_big_ratio"],
    "txt_count": [f"n_{kind}_r{r}{abn}" for abn in ("", "_abn") for kind in ("clu", "first") for r in RELEVANCE] + ["n_src_r1"],
    "txt_tone_gdelt": ["tone_mean_r1", "tone_neg_share_r1", "tone_sd_r1"],
    "txt_tone_lm": ["lm_net_r1", "lm_neg_share_r1", "lm_unc_r1"],
    "txt_novelty": ["novelty_r1"],
    "txt_event": [f"ev_{e}_r1" for e in T.EVENTS] + ["ev_any_r1"],
    "txt_meta": ["n_scored_r1", "tmpl_share_r0", "alias_missing"],
    "txt_text": ["titles_r1"],
}
TABLES = {g: {"daily", "price"} for g in ("core", "scale", "cross", "regime")} | {"event": {"earnings"}, "analyst": {"analyst"}} | {g: {"news"} for g in GROUPS if g == "news" or g.startswith("txt")}


def resolve(items: list[str], extra: dict[str, list[str]] | None = None) -> list[str]:
    """Columns of groups and single names, each once, in order."""
    known = GROUPS | (extra or {})
    return list(dict.fromkeys(c for x in items for c in known.get(x, [x])))


def groups_of(columns: list[str]) -> list[str]:
    """The groups that some columns need; core always."""
    return ["core", *[g for g, own in GROUPS.items() if g != "core" and set(own) & set(columns)]]


def daily_block(daily: DataFrame) -> DataFrame:
    """``symbol, date, close_d0, vol5, vol20, atr14, big_rate60, beta60`` from days up to each date."""
    d = S.loo_median(daily.withColumn("r", F.col("ret") * 100), "rm", F.col("ret"), "date_et").withColumn("rm", F.col("rm") * 100)
    w = S.by("symbol", order="date_et")
    big = F.when(F.col("r").isNotNull(), (F.abs("r") >= 2.5).cast("double"))
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev_close")), F.abs(F.col("low") - F.col("prev_close"))) / F.col("close") * 100
    mean = lambda x: S.rolling(x, w, 60)
    d = d.withColumns({"big": big, "tr": tr})
    cov = mean(F.col("r") * F.col("rm")) - mean(F.col("r")) * mean(F.col("rm"))
    var = mean(F.col("rm") * F.col("rm")) - mean(F.col("rm")) * mean(F.col("rm"))
    return d.select(
        "symbol", F.col("date_et").alias("date"), F.col("close").alias("close_d0"),
        S.rolling(F.col("r"), w, 5, agg=F.stddev_samp).alias("vol5"), S.rolling(F.col("r"), w, 20, agg=F.stddev_samp).alias("vol20"),
        S.rolling(F.col("tr"), w, 14).alias("atr14"), S.rolling(F.col("big"), w, 60).alias("big_rate60"),
        F.coalesce(F.try_divide(cov, var) * 0.5 + 0.5, F.lit(1.0)).alias("beta60"),
    )


def extended_hours(price: DataFrame, leak: bool = False) -> DataFrame:
    """``symbol, day, pre_last, post_last``: last closes of a day's pre-market known before 09:30, and of its post-market.

    leak: the bar known at 09:30 itself counts too, as a contrast.
    """
    day = F.col("datetime").cast("date")
    limit = cutoff(day)
    known = F.col("known_at") <= limit if leak else F.col("known_at") < limit
    last = lambda cond: F.max_by(F.when(cond, F.col("close")), F.when(cond & F.col("close").isNotNull(), F.col("datetime")))
    return price.groupBy("symbol", day.alias("day")).agg(last((F.col("session") == "pre") & known).alias("pre_last"), last(F.col("session") == "post").alias("post_last"))


def gaps(block: DataFrame, hours: DataFrame, calendar: DataFrame) -> DataFrame:
    """The gap family on (symbol, date, target), with the day's regime columns."""
    x = block.join(calendar.where("target is not null"), "date")
    x = x.join(hours.select("symbol", F.col("day").alias("target"), "pre_last"), ["symbol", "target"], "left")
    x = x.join(hours.select("symbol", F.col("day").alias("date"), "post_last"), ["symbol", "date"], "left")
    px = F.coalesce("pre_last", "post_last")
    x = x.withColumns(
        {
            "gap_fallback": (F.col("pre_last").isNull() & F.col("post_last").isNotNull()).cast("double"),
            "gap_missing": px.isNull().cast("double"),
            "gap_pct": (px / F.col("close_d0") - 1) * 100,
        }
    )
    floor = F.when(F.col("vol20").isNotNull(), F.greatest("vol20", F.lit(0.5)))
    x = x.withColumns({"gap_rank": S.pct_rank(F.col("gap_pct"), "target"), "zgap": S.clip(F.col("gap_pct") / floor, -10.0, 10.0)})
    x = S.loo_median(x, "mkt_gap", F.col("gap_pct"), "target")
    x = x.withColumn("resid_gap", F.col("gap_pct") - F.col("beta60") * F.col("mkt_gap")).drop("pre_last", "post_last")
    day = S.Window.partitionBy("target")  # the day's rows are together already
    return x.withColumns({name: c.over(day) for name, c in _regime().items()})


def _regime() -> dict[str, Column]:
    return {
        "reg_med_vol20": F.median("vol20"), "reg_med_absgap": F.median(F.abs("gap_pct")), "reg_gap_disp": F.stddev_samp("gap_pct"),
        "reg_mkt_gap": F.median("gap_pct"), "reg_big_ratio": F.avg((F.abs("gap_pct") >= 1.0).cast("double")),
    }


def regime(x: DataFrame) -> DataFrame:
    """A target day's market: medians and spread over the universe."""
    return x.groupBy("target").agg(*[c.alias(name) for name, c in _regime().items()])


def earnings_block(earnings: DataFrame, calendar: DataFrame) -> DataFrame:
    """The last known values of a window's announcements, each column's own last."""
    e = to_target(earnings.where("symbol is not null"), calendar)
    value = F.coalesce("surprise_pct", F.lit(None).cast("double"))
    e = e.select("symbol", "target", "known_at", F.signum(value).alias("s"), F.abs(S.clip(value, -50.0, 50.0)).alias("a"), S.clip(value, -50.0, 50.0).alias("w"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("known_at", "w")))
    return e.groupBy("symbol", "target").agg(F.lit(1.0).alias("earn"), last("s").alias("surp_sign"), last("a").alias("surp_abs"), last("w").alias("surp_pct_w"))


def analyst_block(analyst: DataFrame, calendar: DataFrame) -> DataFrame:
    a = to_target(analyst.where("symbol is not null"), calendar)
    change = S.clip(F.try_divide(F.col("target_current"), F.col("target_prior")) - 1, -0.5, 0.5)
    count = lambda kind: F.sum((F.col("action") == kind).cast("double"))
    return a.groupBy("symbol", "target").agg(F.count("*").cast("double").alias("an_n"), count("up").alias("an_up"), count("down").alias("an_down"), F.avg(change).alias("an_tgt_chg"))


def grid(symbols: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every symbol on every target day: both are dimensions of a few thousand rows at most."""
    return symbols.select("symbol").distinct().crossJoin(calendar.where("target is not null").select("target").distinct())


def abnormal(x: str, order: str = "target", key: str = "symbol", n: int = NEWS_WINDOW) -> Column:
    """log(1 + x) against log(1 + the mean of the n rows before), null before n rows."""
    w = S.by(key, order=order)
    return F.log1p(x) - F.log1p(S.rolling(F.col(x), w, n, least=n, skip=1))


def news_block(news: DataFrame, calendar: DataFrame, symbols: DataFrame) -> DataFrame:
    """Counts and tone of a window's news, the same title once a symbol and day; days without news are rows of 0."""
    n = to_target(T.explode_symbols(news).join(symbols.select("symbol").distinct(), "symbol"), calendar)
    n = n.withColumn("id", T.title_id(F.col("title"))).groupBy("symbol", "target", "id").agg(F.min_by("tone", F.struct("known_at", "doc_id")).alias("tone"))
    agg = n.groupBy("symbol", "target").agg(F.count("*").cast("double").alias("news_n"), F.avg("tone").alias("tone_mean"), F.min("tone").alias("tone_min"), F.max("tone").alias("tone_max"), F.count_if(F.col("tone") < -5.0).cast("double").alias("tone_neg_tail"))
    g = grid(symbols, calendar).join(agg, ["symbol", "target"], "left").fillna(0.0, ["news_n", "tone_neg_tail"])
    w = S.by("symbol", order="target").rowsBetween(-NEWS_WINDOW, 0)
    missing = ((F.sum("news_n").over(w) == 0) & (F.count("news_n").over(w) == NEWS_WINDOW + 1)).cast("double")
    return g.withColumn("news_abn", abnormal("news_n")).withColumn("news_missing", missing)


def articles(news: DataFrame, calendar: DataFrame, symbols: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row an article and symbol: its target day, keys, whether it is a template, and how it concerns the symbol.

    aliases: ``(ticker, word, pattern)``, ``word`` the lower-case first word of what the pattern finds (several rows a
    company, as ``text.company_names`` makes them). rel 0: tagged only; 1: named in the title; 2: no other company is
    named. Titles are matched once each: their words meet the first words of names, and only those that meet are tried.
    """
    n = to_target(T.explode_symbols(news).join(symbols.select("symbol").distinct(), "symbol"), calendar)
    n = n.withColumn("title", T.clean_title(F.col("title")))
    titles = n.select("title").distinct()
    words = titles.select("title", F.explode(T.first_words(F.col("title"))).alias("word"))
    hits = words.join(aliases.select("ticker", "word", "pattern").distinct(), "word").where(F.expr("title rlike pattern"))
    hits = hits.groupBy("title").agg(F.collect_set("ticker").alias("named"))
    n = n.join(hits, "title", "left")
    own = F.coalesce(F.array_contains("named", F.col("symbol")), F.lit(False))
    count = F.coalesce(F.size("named"), F.lit(0))
    windows = calendar.where("target is not null").select("target").distinct()
    index = windows.withColumn("widx", F.row_number().over(S.Window.orderBy("target")) - 1)
    return n.select(
        "symbol", "target", "doc_id", "known_at", F.coalesce("source", F.lit("")).alias("source"), "title", "tone", T.title_id(F.col("title")).alias("title_id"),
        T.cluster_key(F.col("title")).alias("ckey"), T.is_template(F.col("title")).alias("is_template"),
        F.when(~own, 0).when(count <= 1, 2).otherwise(1).alias("rel"), F.when(own, count).otherwise(0).alias("n_entities"),
    ).join(index, "target")


def first_clusters(rows: DataFrame) -> DataFrame:
    """``symbol, widx, target, ckey, rel, is_first``: stories of a window; new unless told in the five windows before."""
    c = rows.where("is_template = 0").groupBy("symbol", "widx", "target", "ckey").agg(F.max("rel").alias("rel"))
    before = F.lag("widx").over(S.by("symbol", "ckey", order="widx"))
    return c.withColumn("is_first", F.coalesce(F.col("widx") - before > FIRST_LOOKBACK, F.lit(True)))


def representatives(rows: DataFrame) -> DataFrame:
    """The first article of each story that names the symbol, with the story's mean tone."""
    first = F.struct("known_at", "title_id", "doc_id")
    return rows.where("is_template = 0 and rel >= 1").groupBy("symbol", "widx", "target", "ckey").agg(F.min_by("title", first).alias("title"), F.min("known_at").alias("known_at"), F.avg("tone").alias("tone"))


def novelty(reps: DataFrame, back: int = NEWS_WINDOW) -> DataFrame:
    """``symbol, widx, novelty``: the most a title differs from all of the symbol's titles in the windows before.

    Titles meet only where they share a word in this block of windows or the one before: words are rows with unit-length
    weights, and the cosine is a sum. What a frequent word costs grows with the windows looked back, not with history.
    """
    ids = reps.select("symbol", "widx", "ckey", "title")
    words = F.regexp_extract_all(F.lower("title"), F.lit(r"(?U)\b[a-z][a-z'&-]+\b"), F.lit(0))
    tf = ids.select("symbol", "widx", "ckey", F.explode(F.filter(words, lambda x: ~x.isin(T.STOPWORDS))).alias("word")).groupBy("symbol", "widx", "ckey", "word").agg(F.count("*").alias("n"))
    norm = tf.groupBy("symbol", "widx", "ckey").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("len"))
    w = tf.join(norm, ["symbol", "widx", "ckey"]).withColumn("w", F.col("n") / F.col("len")).select("symbol", "widx", "ckey", "word", "w")
    block = F.floor(F.col("widx") / back)
    past = w.select("symbol", F.col("widx").alias("widx0"), F.col("ckey").alias("ckey0"), "word", F.col("w").alias("w0"), F.explode(F.array(block, block + 1)).alias("block"))
    w = w.withColumn("block", block)
    near = (F.col("widx0") >= F.col("widx") - back) & (F.col("widx0") < F.col("widx"))
    sims = w.join(past, ["symbol", "word", "block"]).where(near).groupBy("symbol", "widx", "ckey", "widx0", "ckey0").agg(F.sum(F.col("w") * F.col("w0")).alias("cos"))
    best = sims.groupBy("symbol", "widx", "ckey").agg(F.max("cos").alias("cos"))
    out = ids.select("symbol", "widx", "ckey").join(best, ["symbol", "widx", "ckey"], "left").groupBy("symbol", "widx").agg(F.max(1 - F.coalesce("cos", F.lit(0.0))).alias("novelty"))
    return out


def text_block(news: DataFrame, calendar: DataFrame, symbols: DataFrame, aliases: DataFrame, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """All text features on the grid of symbols and target days."""
    rows = articles(news, calendar, symbols, aliases).persist()  # read six times below; lost parts are made again
    clusters = first_clusters(rows)
    n = lambda cond: F.count_if(cond).cast("double")
    counts = clusters.groupBy("symbol", "target").agg(*[n(F.col("rel") >= r).alias(f"n_clu_r{r}") for r in RELEVANCE], *[n((F.col("rel") >= r) & F.col("is_first")).alias(f"n_first_r{r}") for r in RELEVANCE])
    out = grid(symbols, calendar).join(counts, ["symbol", "target"], "left").fillna(0.0)
    for kind in ("clu", "first"):
        for r in RELEVANCE:
            out = out.withColumn(f"n_{kind}_r{r}_abn", abnormal(f"n_{kind}_r{r}"))
    share = rows.groupBy("symbol", "target").agg(F.avg("is_template").alias("tmpl_share_r0"))
    sources = rows.where("is_template = 0 and rel >= 1").groupBy("symbol", "target").agg(F.count_distinct("source").cast("double").alias("n_src_r1"))
    reps = representatives(rows).persist()
    net, unc = T.lexicon_scores(F.col("title"), lexicon["positive"], lexicon["negative"], lexicon["uncertainty"]) if lexicon else (F.lit(None).cast("double"),) * 2
    scored = reps.withColumns({"lm_net": net, "lm_unc": unc} | T.event_flags(F.col("title")))
    parts = F.array_sort(F.collect_list(F.struct("known_at", "ckey", "title")))
    agg = scored.groupBy("symbol", "target").agg(
        F.avg("tone").alias("tone_mean_r1"), F.avg((F.col("tone") < 0).cast("double")).alias("tone_neg_share_r1"), F.stddev_samp("tone").alias("tone_sd_r1"),
        F.avg("lm_net").alias("lm_net_r1"), F.avg((F.col("lm_net") < 0).cast("double")).alias("lm_neg_share_r1"), F.avg("lm_unc").alias("lm_unc_r1"),
        F.count("*").cast("double").alias("n_scored_r1"), F.array_join(F.transform(parts, lambda x: x["title"]), " || ").alias("titles_r1"),
        *[F.max(f"ev_{e}").cast("double").alias(f"ev_{e}_r1") for e in T.EVENTS],
    )
    new = novelty(reps).join(reps.select("widx", "target").distinct(), "widx").select("symbol", "target", F.col("novelty").alias("novelty_r1"))
    for part in (share, sources, agg, new):
        out = out.join(part, ["symbol", "target"], "left")
    known = aliases.select(F.col("ticker").alias("symbol"), F.lit(0.0).alias("alias_missing")).distinct()
    out = out.withColumn("ev_any_r1", F.greatest(*[f"ev_{e}_r1" for e in T.EVENTS])).join(known, "symbol", "left")
    return out.fillna(0.0, ["n_src_r1", "n_scored_r1"]).fillna(1.0, ["alias_missing"]).fillna("", ["titles_r1"])


def build_features(market, groups: list[str] | None = None, symbols: list[str] | None = None, targets: DataFrame | None = None, aliases: DataFrame | None = None, lexicon: dict | None = None) -> DataFrame:
    """The panel ``symbol, date, target, close_d0, gap_fallback, gap_missing`` and the columns of the groups asked for.

    Only the blocks asked for are planned. The universe (``symbols``) is applied before any cross-sectional statistic.
    Columns that a block has no row for are null; counts are 0. Text groups need aliases, and raise without them.
    """
    if aliases is None and groups and any(g.startswith("txt") for g in groups):
        raise ValueError("text groups need a table of company names (aliases)")
    groups = ["core", *[g for g in GROUPS if g != "core" and (groups is None or g in groups)]]
    calendar = market.calendar if targets is None else targets
    only = lambda t: t if symbols is None else t.where(F.col("symbol").isin(symbols))
    universe = only(market.daily.select("symbol").distinct())
    x = gaps(daily_block(only(market.daily)), extended_hours(only(market.price)), calendar)
    if "event" in groups:
        x = x.join(earnings_block(only(market.earnings), calendar), ["symbol", "target"], "left").fillna(0.0, ["earn"])
    if "analyst" in groups:
        x = x.join(analyst_block(only(market.analyst), calendar), ["symbol", "target"], "left").fillna(0.0, ["an_n", "an_up", "an_down"])
        x = x.withColumn("an_gap_agree", F.coalesce(F.signum(F.col("an_up") - F.col("an_down")) * F.signum("gap_pct"), F.lit(0.0)))
    if "news" in groups:
        x = x.join(news_block(market.news, calendar, universe), ["symbol", "target"], "left")
    if aliases is not None and any(g.startswith("txt") for g in groups):
        x = x.join(text_block(market.news, calendar, universe, aliases, lexicon), ["symbol", "target"], "left")
    wanted = [c for g in groups for c in GROUPS[g] if c in x.columns]
    return x.select("symbol", "date", "target", "close_d0", "gap_fallback", "gap_missing", *wanted)


#: Days of history that a day's features can need: of bars (rolling windows of 60), and of news (20 windows, stories 5 more).
BARS_BACK = 100
NEWS_BACK = 45


def day_features(market, target, groups: list[str] | None = None, symbols: list[str] | None = None, aliases: DataFrame | None = None, lexicon: dict | None = None) -> DataFrame:
    """The panel of one target day from tables cut at its cutoff, and at the history its windows can need.

    Daily and hourly bars go back BARS_BACK trading days, news NEWS_BACK; no window of the batch panel is longer, so its
    rows of the day are the same but for what counts whole windows of news: those need NEWS_BACK trading days of it.
    """
    day = F.lit(target).cast("date")
    own = copy.copy(market)
    end = cutoff(day)
    known = market.calendar.where(F.col("target") <= day)
    last = known.orderBy(F.desc("date")).select("date")
    # the driver reads two days, the starts of the histories
    bars = last.limit(BARS_BACK).agg(F.min("date").cast("timestamp_ntz")).first()[0]
    news = last.limit(NEWS_BACK).agg(F.min("date").cast("timestamp_ntz")).first()[0]
    since = {"daily": bars, "price": bars, "news": news, "earnings": news, "analyst": news}
    for name, start in since.items():
        own.__dict__[name] = as_of(getattr(market, name), end, start)
    own.__dict__["calendar"] = known.where(F.col("date") >= F.lit(news).cast("date")) if news is not None else known
    return build_features(own, groups, symbols, aliases=aliases, lexicon=lexicon).where(F.col("target") == day)


def with_labels(panel: DataFrame, daily: DataFrame) -> DataFrame:
    """The panel joined with its target day's return, label and the part of the return after the gap."""
    got = panel.join(labels(daily).withColumnRenamed("date", "target"), ["symbol", "target"])
    rest = F.log1p(F.col("ret_pct") / 100) - F.log1p(F.col("gap_pct") / 100)
    return got.withColumn("rest", rest * 100)


__all__ = ["build_features", "label_of"]
