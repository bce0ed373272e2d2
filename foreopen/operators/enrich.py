"""Enrichment: social activity, model scores of titles, and the queue of language-model requests.

No request is ever sent from here: requests and responses are tables, joined by the hash of the request.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foreopen.functions import series as S
from foreopen.functions import text as T
from foreopen.operators.asof import to_next_cutoff

NEWS_SCHEMA = "earnings_result string, guidance_action string, analyst_action string, severity double, unexpectedness double"
REDDIT_SCHEMA = "stance string, hype_intensity double, speculation double, short_squeeze double, event_reaction double, disagreement double"


def reddit_mentions(reddit: DataFrame, symbols: DataFrame, targets: DataFrame) -> DataFrame:
    """``symbol, target, sub, mentions``: posts and comments that mention a symbol, each once."""
    own = reddit.where(F.col("body").rlike(r"\$[A-Za-z]|\b[A-Z]{3,5}\b"))
    rows = own.withColumn("symbol", F.explode(T.mentions(F.col("body")))).join(symbols.select("symbol").distinct(), "symbol")
    return to_next_cutoff(rows, targets, "created_et").where("target is not null").groupBy("symbol", "target", "sub").agg(F.count("*").alias("mentions"))


def reddit_activity(reddit: DataFrame, targets: DataFrame) -> DataFrame:
    """``target, sub, n``: everything written in each window."""
    return to_next_cutoff(reddit, targets, "created_et").where("target is not null").groupBy("target", "sub").agg(F.count("*").alias("n"))


def over_median(counts: DataFrame, key: str, value: str) -> DataFrame:
    """Each count against the median of its key's counts, null where that is 0."""
    usual = counts.groupBy(key).agg(F.median(value).alias("_usual"))
    return counts.join(usual, key).withColumn("ratio", F.try_divide(F.col(value), F.col("_usual"))).drop("_usual")


def relative_activity(activity: DataFrame, days: int = 5) -> DataFrame:
    """``target, sub, relative, smooth``: a sub's share of its own mean, and the mean of that over the last days."""
    own = F.col("n") / F.avg("n").over(Window.partitionBy("sub"))
    x = activity.select("target", "sub", own.alias("relative"))
    return x.withColumn("smooth", F.avg("relative").over(S.by("sub", order="target").rowsBetween(-(days - 1), 0)))


def activity_pivot(activity: DataFrame, subs: list[str]) -> DataFrame:
    return activity.groupBy("target").pivot("sub", subs).agg(F.sum("n")).fillna(0, subs)


def abnormal_ewm(counts: DataFrame, symbols: DataFrame, targets: DataFrame, value: str = "mentions", span: float = 20) -> DataFrame:
    """log(1 + x) against log(1 + its smoothed level before), on the full grid of symbols and days."""
    g = symbols.select("symbol").distinct().crossJoin(targets.select("target").distinct())
    g = g.join(counts.groupBy("symbol", "target").agg(F.sum(value).cast("double").alias(value)), ["symbol", "target"], "left").fillna(0.0, [value])
    s = S.smooth(g, "symbol", "target", value, "level", S.span_to_alpha(span))
    before = F.lag("level").over(S.by("symbol", order="target"))
    return s.withColumn("abn", F.log1p(value) - F.log1p(before)).drop("level")


def import_scores(scores: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Class probabilities of titles, once a title; raises if any do not sum to 1 or a title comes twice."""
    bad = scores.where(F.abs(F.col("p_pos") + F.col("p_neg") + F.col("p_neu") - 1) > tolerance).limit(1).count()
    twice = scores.groupBy("title_id").count().where("count > 1").limit(1).count()
    if bad or twice:
        raise ValueError(f"scores: {'a row does not sum to 1' if bad else 'a title comes twice'}")
    return scores


def export_titles(rows: DataFrame) -> DataFrame:
    """``title_id, title``: representatives to be scored elsewhere, once each."""
    return rows.groupBy("title_id").agg(F.min("title").alias("title"))


def top_class(pos: Column, neg: Column, neu: Column) -> Column:
    """The class of largest probability; the first of positive, negative, neutral on ties."""
    most = F.greatest(pos, neg, neu)
    return F.when(pos == most, "positive").when(neg == most, "negative").when(neu == most, "neutral")


def title_features(reps: DataFrame, scores: DataFrame, dims: int = 0, early: Column | None = None) -> DataFrame:
    """``symbol, target, fb_net, fb_neg_share, fb_n`` and, with dims, mean principal components of the embeddings.

    Components are fitted on the early rows only, about their mean.
    """
    x = reps.join(scores, "title_id")
    aggs = [F.avg(F.col("p_pos") - F.col("p_neg")).alias("fb_net"), F.avg((top_class(F.col("p_pos"), F.col("p_neg"), F.col("p_neu")) == "negative").cast("double")).alias("fb_neg_share"), F.count("*").alias("fb_n")]
    if dims:
        x = components(x, "embedding", dims, early if early is not None else F.lit(True))
        aggs += [F.avg(F.get("pc", F.lit(i))).alias(f"fb_pc{i}") for i in range(dims)]
    return x.groupBy("symbol", "target").agg(*aggs)


def components(df: DataFrame, column: str, dims: int, early: Column) -> DataFrame:
    """Adds ``pc``: principal components of a vector column, fitted on the early rows about their mean."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.withColumn("_v", array_to_vector(F.col(column).cast("array<double>")))
    scaler = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(v.where(early))
    v = scaler.transform(v)
    return PCA(k=dims, inputCol="_c", outputCol="_p").fit(v.where(early)).transform(v).withColumn("pc", vector_to_array("_p")).drop("_v", "_c", "_p")


def request_key(schema: str, text: Column, model: str = "none", effort: str = "low", version: str = "1") -> Column:
    """Hash of a request: what is asked, of which model, about which text."""
    head = json.dumps({"effort": effort, "model": model, "prompt_version": version, "schema": schema}, sort_keys=True)
    return F.sha2(F.concat_ws("\n", F.lit(head), text), 256)


def pending(requests: DataFrame, responses: DataFrame, budget: int | None = None, attempts: int = 1) -> DataFrame:
    """Requests ``(key, text)`` without an answer, once each; a budget takes the first by key.

    responses: ``(key)``, or ``(key, response)``, where a null response is a failed attempt: such requests come again
    until they have failed ``attempts`` times.
    """
    if "response" in responses.columns:
        tries = responses.groupBy("key").agg(F.count("response").alias("ok"), F.count("*").alias("n"))
        responses = tries.where((F.col("ok") > 0) | (F.col("n") >= attempts))
    out = requests.dropDuplicates(["key"]).join(responses.select("key"), "key", "left_anti")
    return out if budget is None else out.orderBy("key").limit(budget)


def expected_cost(requests: DataFrame, per_million: float, text: str = "text", answer_chars: int = 400, chars_a_token: float = 4.0) -> DataFrame:
    """``requests, tokens, cost`` of what would be sent, before anything is."""
    tokens = F.sum((F.length(text) + answer_chars) / chars_a_token)
    return requests.agg(F.count("*").alias("requests"), F.coalesce(tokens, F.lit(0.0)).alias("tokens"), (F.coalesce(tokens, F.lit(0.0)) * per_million / 1e6).alias("cost"))


def parse(responses: DataFrame, schema: str) -> DataFrame:
    """``key`` and the fields of JSON responses; text that isn't JSON of the schema gives nulls."""
    return responses.select("key", F.from_json("response", schema).alias("r")).select("key", "r.*")


def news_signs(parsed: DataFrame) -> DataFrame:
    """One sign of each parsed headline, with severity and surprise."""
    point = lambda c, good, bad: F.when(F.col(c) == good, 1).when(F.col(c) == bad, -1).otherwise(0)
    total = point("earnings_result", "beat", "miss") + point("guidance_action", "raise", "cut") + point("analyst_action", "upgrade", "downgrade")
    return parsed.withColumn("sign", F.signum(total.cast("double"))).withColumn("unexpected", F.col("unexpectedness"))


def reddit_scores(parsed: DataFrame) -> DataFrame:
    bull = F.when(F.col("stance") == "bullish", 1.0).when(F.col("stance") == "bearish", -1.0).otherwise(0.0)
    return parsed.select("key", bull.alias("bull"), F.col("hype_intensity").alias("hype"), "speculation", "short_squeeze", "event_reaction", "disagreement")


def agreement(df: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """How often two figures are equal within rounding, and their mean distance."""
    close = F.abs(F.col(a) - F.col(b)) <= 1e-8 + 1e-5 * F.abs(F.col(b))
    return df.groupBy(*keys).agg(F.avg(close.cast("double")).alias("agreement"), F.avg(F.abs(F.col(a) - F.col(b))).alias("mae"), F.count("*").alias("n"))


def majority(df: DataFrame, key: str, vote: str) -> DataFrame:
    """The commonest vote of each key, the smallest on ties; null votes don't count."""
    n = df.where(F.col(vote).isNotNull()).groupBy(key, vote).agg(F.count("*").alias("n"))
    first = Window.partitionBy(key).orderBy(F.desc("n"), vote)
    return n.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(key, F.col(vote).alias("silver"))


def silver_eval(df: DataFrame, silver: str, guess: str) -> DataFrame:
    """``class, precision, recall, n`` of guesses against majority labels."""
    hit = F.col(silver) == F.col(guess)
    got = df.where(F.col(silver).isNotNull() & F.col(guess).isNotNull())
    recall = got.groupBy(F.col(silver).alias("class")).agg(F.avg(hit.cast("double")).alias("recall"), F.count("*").alias("n"))
    precision = got.groupBy(F.col(guess).alias("class")).agg(F.avg(hit.cast("double")).alias("precision"))
    return recall.join(precision, "class", "full")


def placebo(df: DataFrame, moment: str, year: str, month: str, *keys: str) -> DataFrame:
    """How often a guessed year, and month, is the right one."""
    at = F.col(moment)
    return df.groupBy(*keys).agg(F.avg((F.year(at) == F.col(year)).cast("double")).alias("year_acc"), F.avg(((F.year(at) == F.col(year)) & (F.month(at) == F.col(month))).cast("double")).alias("month_acc"), F.count("*").alias("n"))
