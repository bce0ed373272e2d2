"""Vectorizers, names, lexicons and text regimes against plain Python."""

import datetime as dt
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foreopen.functions import text as T
from foreopen.operators import decisions as D
from foreopen.operators import enrich as N
from foreopen.operators import features as X

TITLES = [
    "Acme beats Q3 estimates, raises outlook 4.5%", "Acme's shares rise 12% after the beat", "Not a good day for Acme and Bolt", "Bolt & Co. sued over recall",
    "", None, "the of and", "Bolt-On deal: $ACM to buy Bolt for 1,200 million", "good good good Acme", "ab a  b", "Caf\u00e9 Acme caf\u00e9",
]


@pytest.fixture(scope="module")
def titles(spark):
    return spark.createDataFrame(list(enumerate(TITLES)), "i int, title string")


def words(t):
    return re.findall(T.VEC_TOKEN, (t or "").lower())


def chars(t):
    out = []
    for w in re.sub(r"\s+", " ", (t or "").lower()).split():
        w = f" {w} "
        for n in (3, 4, 5):
            out.append(w[:n])
            k = 0
            while k + n < len(w):
                k += 1
                out.append(w[k : k + n])
            if k == 0:
                break
    return out


TERMS = {
    "count_uni": words, "tfidf_uni": words, "tfidf_df": words, "lm_vocab": words, "tfidf_char": chars,
    "tfidf_bi": lambda t: words(t) + [f"{a} {b}" for a, b in zip(words(t), words(t)[1:], strict=False)],
    "tfidf_stop": lambda t: [w for w in words(t) if w not in T.STOPWORDS or w in T.NEGATORS],
}


@pytest.mark.parametrize("kind", sorted(TERMS))
def test_vectorizers(spark, titles, kind):
    """Every weight, by term, against the plain formulas."""
    low, high = {"tfidf_df": (2, 0.4), "lm_vocab": (1, 1.0)}.get(kind, (2, 1.0))
    lexicon = ["good", "BEAT", "sued"]
    v = T.Vectorizer(kind, min_df=low, max_df=high, lexicon=lexicon).fit(titles)
    got = {r["i"]: dict(zip(map(int, r["features"].indices), map(float, r["features"].values), strict=True)) for r in v.transform(titles).collect()}
    terms = [Counter(TERMS[kind](t)) for t in TITLES]
    df = Counter(x for c in terms for x in c)
    kept = {x for x, n in df.items() if n >= low and (high == 1.0 or n <= high * len(TITLES))} if kind != "lm_vocab" else {w.lower() for w in lexicon}
    names = v.counts.vocabulary
    assert set(names) == kept
    for i, c in enumerate(terms):
        want = {x: n for x, n in c.items() if x in kept}
        if kind.startswith("tfidf"):
            want = {x: (1 + math.log(n)) * (math.log((1 + len(TITLES)) / (1 + df[x])) + 1) for x, n in want.items()}
            norm = math.sqrt(sum(w * w for w in want.values())) or 1.0
            want = {x: w / norm for x, w in want.items()}
        assert {names[k]: w for k, w in got[i].items()} == pytest.approx(want)


@pytest.mark.parametrize("kind", [k for k, (weighted, _, _) in T.VECTORIZERS.items() if weighted])
def test_weights_read_counts_of_the_row_below(spark, titles, kind):
    """No Python function stands over the terms' own expressions, where Spark at times leaves it unevaluated."""
    plan = T.Vectorizer(kind, min_df=2, max_df=1.0).fit(titles).transform(titles)._jdf.queryExecution().optimizedPlan().toString()
    lines = [x for x in plan.splitlines() if "<lambda>(" in x]
    assert lines and not any("lambdafunction" in x or "split(" in x or "regexp_extract_all(" in x for x in lines)


def test_no_term_is_cut(spark):
    """A vocabulary of over 2^18 terms is kept whole, as SQL has it, unless bounded."""
    rows = spark.range(0, 300_000, 100, 4).select(F.array_join(F.sequence("id", F.col("id") + 99), " ").alias("title"))
    v = T.Vectorizer("count_uni", min_df=1).fit(rows)
    n = F.udf(lambda x: int(x.numNonzeros()), "int")
    assert len(v.counts.vocabulary) == 300_000 and {r[0] for r in v.transform(rows).select(n("features")).collect()} == {100}
    assert len(T.Vectorizer("count_uni", min_df=1, most=50).fit(rows).counts.vocabulary) == 50


def test_hashing(spark, titles):
    got = {r["i"]: r["features"] for r in T.Vectorizer("hashing").fit(titles).transform(titles).collect()}
    for i, t in enumerate(TITLES):
        n = Counter(words(t))
        norm = math.sqrt(sum(x * x for x in n.values()))
        assert got[i].size == 1 << 18 and sorted(got[i].values) == pytest.approx(sorted(x / norm for x in n.values()))


def test_bad_vectorizers():
    with pytest.raises(ValueError):
        T.Vectorizer("none")
    with pytest.raises(ValueError):
        T.Vectorizer("lm_vocab")


NAMES = {"ACM": ["Acme", "Acme Corp"], "BLT": ["Bolt & Co.", "Bolt"], "GE": ["General"], "V": ["\u00d6mer"], "_note": ["ignored"]}


def test_company_names(spark, titles):
    """The equi-join on first words finds what every pattern tried on every title finds."""
    more = ["$ge up", "GE up", "generals", "General's day", "bolt & co. x", "a $V b", "V for", "\u00d6mer says", "3ACM", "xACM", "ACM.", "BOLT"]
    rows = titles.unionByName(spark.createDataFrame(list(enumerate(more, 100)), "i int, title string")).where("title is not null")
    table = T.company_names(spark, NAMES)
    hits = rows.withColumn("word", F.explode(T.first_words(F.col("title")))).join(table, "word").where(F.expr("title rlike pattern"))
    got = {(r["i"], r["ticker"]) for r in hits.select("i", "ticker").distinct().collect()}
    ascii_word = {t: re.compile(T.symbol_pattern(t, n), re.ASCII) for t, n in NAMES.items() if t != "_note"}
    want = {(i, t) for i, x in [*enumerate(TITLES), *enumerate(more, 100)] if x for t, p in ascii_word.items() if p.search(x)}
    assert got == want and (100, "GE") not in got and (101, "GE") not in got and (102, "GE") not in got and (103, "GE") in got


def test_anonymize_for_a_target(spark):
    names = {"ACM": ["Acme"], "BLT": ["Bolt"]}
    x = spark.createDataFrame([("$acm and Acme's rival Bolt on Jan 5, 2024: ACM $XYZ  up",)], "t string")
    assert x.select(T.anonymize(F.col("t"), names, "ACM")).first()[0] == "[TARGET] and [TARGET] rival [OTHER] on [DATE]: [TARGET] [OTHER] up"
    assert x.select(T.anonymize(F.col("t"), names)).first()[0] == "[COMPANY] and [COMPANY] rival [COMPANY] on [DATE]: [COMPANY] [COMPANY] up"


@pytest.fixture(scope="module")
def news(spark):
    days = [dt.date(2024, 1, d) for d in range(1, 9)]
    cal = spark.createDataFrame(list(zip(days, [*days[1:], None], strict=True)), "date date, target date")
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [(1, at(2, 10), "ACM", "Acme wins a good deal", 1.0), (2, at(2, 11), "ACM", "Acme had a loss", -2.0), (3, at(3, 10), "ACM,BLT", "Bolt may be good for Acme", 0.0), (4, at(3, 12), "BLT", "nothing here", 0.5)]
    news = spark.createDataFrame([(i, k, s, "src", t, tone) for i, k, s, t, tone in rows], "doc_id long, known_at timestamp_ntz, symbols string, source string, title string, tone double")
    return news, cal, spark.createDataFrame([("ACM",), ("BLT",)], "symbol string")


def test_lexicon_in_the_text_block(spark, news):
    table, cal, symbols = news
    lexicon = {"positive": ["good"], "negative": ["loss"], "uncertainty": ["may"]}
    got = {(r["symbol"], r["target"].day): r for r in X.text_block(table, cal, symbols, T.company_names(spark, {"ACM": ["Acme"], "BLT": ["Bolt"]}), lexicon).collect()}
    day = got["ACM", 3]
    assert day["lm_net_r1"] == pytest.approx((1 / 5 - 1 / 4) / 2) and day["lm_neg_share_r1"] == 0.5 and day["lm_unc_r1"] == 0
    assert got["BLT", 4]["lm_unc_r1"] == pytest.approx(1 / 6) and got["BLT", 4]["n_scored_r1"] == 1 and got["ACM", 5]["lm_net_r1"] is None
    assert {r["alias_missing"] for r in got.values()} == {0.0}


def panel(spark, n=400, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        big = r.random() < 0.4
        words = r.choice(["calm", "steady", "usual"] if not big else ["shock", "plunge", "usual"], 3)
        gap = float(r.normal() * (1.5 if big else 0.3))
        ret = gap * 2
        label = 0 if ret < -2.5 else 1 if ret < -0.6 else 2 if ret < 0.6 else 3 if ret < 2.5 else 4
        rows.append((f"S{i % 20}", dt.date(2024, 1, 1) + dt.timedelta(days=i // 20), gap, label, "" if i % 17 == 0 else " ".join(words), None if i % 5 == 0 else float(big)))
    return spark.createDataFrame(rows, "symbol string, target date, gap_pct double, label int, titles_r1 string, hint double")


@pytest.mark.parametrize("params", [{"vectorizer": "count_uni", "min_df": 2}, {"vectorizer": "tfidf_uni", "min_df": 2}, {"input": "columns", "columns": ["hint"]}])
def test_text_regime(spark, params):
    x = panel(spark).cache()
    pipe = D.Pipeline(D.Spec("t", "column", "k", "textclf", params=params)).fit(x)
    got = pipe.predict(x)
    by = {r["big"]: r["p"] for r in got.groupBy(F.col("label").isin(0, 4).alias("big")).agg(F.avg(D.BIG).alias("p")).collect()}
    assert by[True] > by[False] + 0.1 and got.where("pred is null").count() == 0
    if params.get("input") != "columns":
        assert got.where(f"titles_r1 = '' and {D.BIG} is not null").count() == 0
        names = [n for n, _ in pipe.big.terms(2)]
        assert names[0] in ("shock", "plunge") and names[-1] in ("calm", "steady")


def test_text_regime_of_one_kind(spark):
    x = panel(spark, 60).withColumn("label", F.lit(2))
    assert {r["p"] for r in D.BigMove({}).fit(x).values(x).select(F.col(D.BIG).alias("p")).collect()} == {0.0, None}


def plain_score(y, q):
    w = lambda i, j: (i - j) ** 2 * (i - 2) ** 2
    n = len(y)
    num = sum(w(i, j) for i, j in zip(y, q, strict=True))
    den = sum(w(i, j) * y.count(i) * q.count(j) for i in range(5) for j in range(5)) / n
    return 1 - num / den if den else None


def test_decomposed_thresholds(spark):
    """The grid over lowered probabilities finds the score that trying every pair of quantiles on every row finds."""
    r = np.random.default_rng(3)
    rows = [(float(a), float(b), float(c), int(np.clip(round(2 + (c - 0.5) * 6 * (a > 0.4)), 0, 4))) for a, b, c in r.random((150, 3))]
    best = D.fit_decomposed(spark.createDataFrame(rows, "p_move double, p_ext double, p_up double, label int"), gate=True).first()
    y = [x[3] for x in rows]
    a, b, c = (np.array([x[k] for x in rows]) for k in range(3))
    levels = np.arange(1, 20) * 0.05
    top = -9
    for tm in np.unique(np.quantile(a, levels)):
        for te in np.unique(np.quantile(b, levels)):
            for g in (0.0, 0.05, 0.1, 0.15, 0.2, 0.3):
                ext, up = (b >= te) & (abs(c - 0.5) >= g), c >= 0.5
                q = np.where(a < tm, 2, np.where(up, np.where(ext, 4, 3), np.where(ext, 0, 1))).tolist()
                top = max(top, plain_score(y, q) or -9)
    assert best["score"] == pytest.approx(top)


def test_four_bounds(spark):
    """Coordinate descent ends no worse than it began, in order, at a place no single step improves."""
    r = np.random.default_rng(5)
    s = r.normal(size=300) * 2
    y = [int(np.searchsorted([-2.5, -0.6, 0.6, 2.5], v + e, side="right")) for v, e in zip(s, r.normal(size=300), strict=True)]
    df = spark.createDataFrame([(float(v), k) for v, k in zip(s, y, strict=True)], "s double, label int")
    got = D.fit_four(df)
    score = lambda b: plain_score(y, [int(sum(v >= e for e in b)) for v in s])
    assert got == sorted(got) and score(got) >= D.fit_asym(df).first()["score"] - 1e-9
    q = np.unique(np.quantile(s, np.linspace(0.005, 0.995, 80)))
    for k in range(4):
        for c in q[(q > (got[k - 1] if k else -99)) & (q < (got[k + 1] if k < 3 else 99))][::7]:
            assert score([*got[:k], float(c), *got[k + 1 :]]) <= score(got) + 1e-9


def test_components_rebuild_their_vectors(spark):
    """As many components as dimensions, times their axes, give the centred vectors back: lengths and distances agree."""
    r = np.random.default_rng(2)
    x = r.normal(size=(40, 5)) @ r.normal(size=(5, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, e array<double>")
    got = {q["i"]: np.array(q["pc"]) for q in N.components(df, "e", 5, F.lit(True)).collect()}
    c = x - x.mean(0)
    y = np.stack([got[i] for i in range(40)])
    y = y - y.mean(0)
    assert np.linalg.norm(y, axis=1) == pytest.approx(np.linalg.norm(c, axis=1)) and y @ y.T == pytest.approx(c @ c.T, abs=1e-9)
    assert (np.diff(y.var(0)) <= 1e-9).all()


def test_request_queue(spark):
    req = spark.createDataFrame([("a", "x" * 400), ("b", "y"), ("c", "z"), ("a", "x" * 400)], "key string, text string")
    res = spark.createDataFrame([("a", None), ("b", None), ("b", None), ("c", "{}")], "key string, response string")
    assert {r["key"] for r in N.pending(req, res, attempts=2).collect()} == {"a"} and {r["key"] for r in N.pending(req, res, attempts=3).collect()} == {"a", "b"}
    assert N.expected_cost(req.where("key = 'a'").dropDuplicates(), 2.0).first()["tokens"] == 200
