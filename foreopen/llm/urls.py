"""URL filters: rules on host and path, and gradient-boosted trees on lexical features for the urls no rule fits.

Features are made by SQL expressions; the trees are fitted in numpy on a bounded number of labelled urls and applied as
SQL expressions again, so that scoring runs in the JVM. Suffixes and the words of hosts count by the share of blocked
urls among the labelled ones that have them.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foreopen.llm.common import lower_ascii, read

#: Verdicts by rule: a host with its subdomains, and the beginning of a path.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
FEATURES = ("length", "host_length", "depth", "digits", "hyphens", "entropy", "params", "labels", "vowels", "segment", "word_max", "word_mean", "suffix", "tld")


def host_of(url: Column) -> Column:
    return F.when(url.contains("://"), lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def match(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null. A rule is ``host/path``."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return F.lit(None).cast("string") if out is None else out


def _share(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")) / F.greatest(F.length(text), F.lit(1))


def suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def features(urls: DataFrame, known: DataFrame | None, words: dict[str, float] | None = None) -> DataFrame:
    """FEATURES of ``(url)``; known: ``(suffix, rate)`` of suffixes among labelled urls, a broadcast of bounded size.

    words: rates of a bounded number of words; a host without any of them has 0.5.
    """
    url = F.coalesce("url", F.lit(""))
    out = urls.withColumn("_url", url).withColumn("_host", host_of(url)).withColumn("_path", path_of(url))
    host, path, whole = F.col("_host"), F.col("_path"), F.col("_url")
    chars = F.split(whole, "")
    n = F.greatest(F.length(whole), F.lit(1)).cast("double")
    often = lambda c: (F.length(whole) - F.length(F.replace(whole, c, F.lit("")))) / n
    query = F.when(F.instr(whole, "?") > 0, F.substring_index(F.substring_index(whole, "?", -1), "#", 1)).otherwise("")
    rates = F.lit(None).cast("array<double>")
    if words:
        table = F.map_from_arrays(F.array(*map(F.lit, words)), F.array(*map(F.lit, words.values())))
        rates = F.filter(F.transform(F.split(host, "[.-]"), lambda w: F.element_at(table, w)), lambda r: r.isNotNull())
    mean = F.aggregate("_rates", F.lit(0.0), lambda s, r: s + r) / F.size("_rates")
    out = out.withColumn("_rates", rates).withColumns(
        {
            "length": F.length(whole).cast("double"),
            "host_length": F.length(host).cast("double"),
            "depth": (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("double"),
            "digits": _share(whole, "[^0-9]"),
            "hyphens": _share(host, "[^-]") * F.length(host),
            "entropy": -F.aggregate(F.array_distinct(F.filter(chars, lambda c: c != "")), F.lit(0.0), lambda s, c: s + often(c) * F.log2(often(c))),
            "params": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
            "labels": F.size(F.split(host, r"\.")).cast("double"),
            "vowels": _share(host, "[^aeiou]"),
            "segment": F.array_max(F.transform(F.split(path, "/"), lambda x: F.length(x))).cast("double"),
            "word_max": F.coalesce(F.array_max("_rates"), F.lit(0.5)),
            "word_mean": F.when(F.size("_rates") > 0, mean).otherwise(0.5),
        }
    )
    for name, k in (("suffix", 2), ("tld", 1)):
        if known is None:
            out = out.withColumn(name, F.lit(0.5))
        else:
            own = F.broadcast(known.select(F.col("suffix").alias("_key"), F.col("rate").alias(name)))
            out = out.join(own, suffix(host, k) == F.col("_key"), "left").drop("_key").fillna(0.5, [name])
    return out.drop("_rates")


def suffix_rates(labelled: DataFrame, least: int = 5) -> DataFrame:
    """``(suffix, rate)``: the smoothed share of blocked urls of each last label and last two labels of the host.

    Suffixes of fewer than ``least`` labelled urls are left out: their rate would tell those urls' own labels.
    """
    host = host_of(F.col("url"))
    each = labelled.select(F.explode(F.array_distinct(F.array(suffix(host, 1), suffix(host, 2)))).alias("suffix"), "label")
    got = each.groupBy("suffix").agg(((F.sum("label") + 5.0) / (F.count("*") + 10.0)).alias("rate"), F.count("*").alias("n"))
    return got.where(F.col("n") >= least).select("suffix", "rate")


def word_rates(rows: list[tuple[str, int]], most: int, least: int = 5) -> dict[str, float]:
    """Smoothed shares of blocked urls of the words of hosts that ``least`` labelled urls have; ``most`` at most."""
    seen, bad = Counter(), Counter()
    for url, label in rows:
        host = url.split("://", 1)[-1] if "://" in url else ""
        for w in set(re.split("[.-]", re.split("[/?#]", host, maxsplit=1)[0].lower())) - {""}:
            seen[w] += 1
            bad[w] += label
    often = sorted((w for w, n in seen.items() if n >= least), key=lambda w: (-seen[w], w))[:most]
    return {w: (bad[w] + 2.0) / (seen[w] + 4.0) for w in sorted(often)}


def leaf_values(tree, rows: np.ndarray) -> np.ndarray:
    """What one tree adds to each row's log odds."""
    if isinstance(tree, float):
        return np.full(len(rows), tree)
    k, t, a, b = tree
    out, low = np.empty(len(rows)), rows[:, k] <= t
    out[low], out[~low] = leaf_values(a, rows[low]), leaf_values(b, rows[~low])
    return out


def probability(base: float, forest: list, rows: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(base + sum((leaf_values(t, rows) for t in forest), np.zeros(len(rows))))))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32) -> tuple[float, list]:
    """Log-loss boosting: the first guess, and trees as nested ``(feature, threshold, left, right)`` or a leaf value."""
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    guess = np.full(len(y), base)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for k in range(x.shape[1])]

    def grow(own: np.ndarray, left: int):
        g, h = grad[own], hess[own]
        value = float(g.sum() / (h.sum() + 1.0))
        if left == 0 or len(own) < 20:
            return rate * value
        whole, best = g.sum() ** 2 / (h.sum() + 1.0), (1e-6, None, None)
        for k, c in enumerate(cuts):
            if not len(c):
                continue
            at = np.searchsorted(c, x[own, k], side="left")
            gs, hs, ns = (np.cumsum(np.bincount(at, w, len(c) + 1))[:-1] for w in (g, h, np.ones(len(own))))
            gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - whole
            gain[(ns < 10) | (len(own) - ns < 10)] = -1
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (gain[j], k, float(c[j]))
        if best[1] is None:
            return rate * value
        low = x[own, best[1]] <= best[2]
        return best[1], best[2], grow(own[low], left - 1), grow(own[~low], left - 1)

    forest = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-guess))
        grad, hess = y - p, p * (1 - p)
        forest.append(grow(np.arange(len(y)), depth))
        guess = guess + leaf_values(forest[-1], x)
    return base, forest


def expression(base: float, forest: list) -> str:
    """The model's probability as SQL over FEATURES."""

    def tree(t) -> str:
        if isinstance(t, float):
            return f"{t!r}D"
        k, cut, a, b = t
        return f"if(`{FEATURES[k]}` <= {cut!r}D, {tree(a)}, {tree(b)})"

    return f"1 / (1 + exp(-({' + '.join([f'{base!r}D', *map(tree, forest)])})))"


#: Words of hosts made for advertisement, betting, counterfeit and adult trade; words that both kinds use; ordinary ones.
TRADE = "casino pills spam bets adult xxx ads win cheap loans replica viagra poker lottery bonus click jackpot slots".split()
EITHER = "free track online store now deal zone club shop best top mobile live net play game".split()
PLAIN = "library weather garden museum school travel kitchen science forum music village history river letters press radio".split()
TLDS = "com net org info biz de fr es".split()


def examples(n: int = 6000, seed: int = 17) -> list[tuple[str, int]]:
    """Labelled urls drawn from two overlapping descriptions: in no single feature do the classes lie apart.

    Blocked ones have trade words, hyphens, digits, many parameters and random path parts more often; all of these occur
    in allowed ones too, and blocked ones without any of them do.
    """
    r = np.random.default_rng(seed)
    pick = lambda xs, p=None: xs[r.choice(len(xs), p=p)]
    letters = lambda k, of: "".join(pick(of) for _ in range(k))

    def name(bad: bool) -> str:
        kind = r.random()
        if kind < 0.2:  # an abbreviation or invented name
            return letters(r.integers(4, 10), "bcdfghjklmnprstvwyhtnr" + ("aeio" if r.random() < 0.6 else ""))
        if kind < 0.35:
            return "".join(pick(["the", "tion", "ing", "er", "an", "ble", "on", "re", "la", "mi", "so", "ka"]) for _ in range(r.integers(2, 4)))
        return pick(TRADE if r.random() < (0.6 if bad else 0.03) else EITHER if r.random() < (0.6 if bad else 0.25) else PLAIN)

    out = []
    for _ in range(n):
        bad = bool(r.random() < 0.4)
        parts = [name(bad) for _ in range(1 + r.binomial(2, 0.5 if bad else 0.3))]
        if bad and r.random() < 0.85 and not set(parts) & set(TRADE):
            parts[0] = pick(TRADE)
        host = ("-" if r.random() < (0.75 if bad else 0.3) else "").join(parts) + (str(r.integers(1, 999)) if r.random() < (0.25 if bad else 0.1) else "")
        host = pick(["", "", "www.", "m.", "blog."]) + host + pick(["", ".example"]) + "." + pick(TLDS, np.array([4, 2, 1, 2, 2, 1, 1, 1] if bad else [4, 2, 3, 1, 0.5, 1, 1, 1]) / (14 if bad else 13.5))
        depth = 1 + r.binomial(4, 0.25 if bad else 0.35)
        path = ["/" + (letters(r.integers(6, 24), "0123456789abcdef") if r.random() < (0.35 if bad else 0.12) else str(r.integers(1, 50_000)) if r.random() < 0.5 else pick(["en", "de", "fr", "es", *EITHER, *PLAIN])) for _ in range(depth)]
        path = "".join(path) + pick(["", "/", ".html", "#top", ""])
        params = r.binomial(6, 0.35 if bad else 0.15) if r.random() < 0.6 else 0
        query = "&".join(pick(["ref", "id", "page", "utm_source", "aff", "q"]) + "=" + (letters(r.integers(3, 14), "0123456789abcdef") if r.random() < (0.5 if bad else 0.2) else pick(["x", "feed", "2", *PLAIN])) for _ in range(params))
        out.append((f"http{pick(['', 's', 's'])}://{host}{path}" + (f"?{query}" if query and "#" not in path else ""), int(bad)))
    return out


def fit(labelled: DataFrame, max_labelled: int = 20_000, max_words: int = 500) -> tuple[str, DataFrame, dict[str, float]] | None:
    """The model of ``(url, label)`` with label 1 for block: an expression, suffix and word rates; None without labels.

    At most ``max_labelled`` urls, chosen by hash, reach the driver; of equal ones any are alike, so ties don't matter.
    ``max_words`` words are kept, the most frequent first.
    """
    got = trained(labelled, max_labelled, max_words)
    return None if got is None else (expression(*got[:2]), *got[2:])


def trained(labelled: DataFrame, max_labelled: int, max_words: int) -> tuple[float, list, DataFrame, dict[str, float]] | None:
    spark = labelled.sparkSession
    own = labelled.where("url is not null and label in (0, 1)").orderBy(F.xxhash64("url"), "url", "label").limit(max_labelled).select("url", "label")
    rows = [(r["url"], int(r["label"])) for r in own.collect()]
    if not rows:
        return None
    own = spark.createDataFrame(rows, "url string, label int")
    rates = spark.createDataFrame([tuple(r) for r in suffix_rates(own).collect()], "suffix string, rate double")
    words = word_rates(rows, max_words)
    table = features(own, rates, words).select(*FEATURES, "label").toPandas().to_numpy(float)
    return *boost(table[:, :-1], table[:, -1]), rates, words


def judge(pages: DataFrame, model: tuple[str, DataFrame, dict[str, float]] | None, rules: dict[str, str] = RULES, at_least: float = 0.5) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` of every url.

    score is the trees' probability of block (0.5 without a model); the verdict is the rule's, else block from
    ``at_least`` on (allow without a model). A null url, or one without ``://``, has an empty host and path. Urls of any length are
    read whole; of rules that fit, the longest wins, of equally long ones the first by name. Repeated rows are judged
    alike; other columns are ignored; an empty table gives no rows.
    """
    own = features(pages.select("page_id", "url"), *(model[1:] if model else (None, None)))
    score = F.expr(model[0]) if model else F.lit(0.5)
    rule = match(F.col("_host"), F.col("_path"), rules)
    verdict = F.when(F.col("score") >= at_least, "block").otherwise("allow") if model else F.lit("allow")
    for name in sorted(rules):
        verdict = F.when(F.col("rule") == name, rules[name]).otherwise(verdict)
    out = own.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"), score.alias("score"))
    return out.withColumn("verdict", verdict).select("page_id", "host", "path", "rule", "verdict", "score")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit(spark.createDataFrame(examples(), "url string, label int"))
    return judge(read(spark, sf_dir, "pages"), model)
