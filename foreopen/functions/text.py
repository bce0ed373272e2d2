"""Text columns for headlines and posts."""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Word lists and patterns that decide results.
NEGATORS = ["no", "not", "never", "without", "neither", "nor", "none", "cannot", "nobody", "nothing"]
STOPWORDS = [
    "a", "an", "the", "of", "in", "on", "at", "to", "for", "by", "with", "from", "and", "or", "as",
    "is", "are", "was", "were", "be", "been", "its", "it", "this", "that", "these", "those", "into",
    "over", "after", "before", "about", "s", "inc", "corp", "co", "ltd", "plc", "llc", "nyse", "nasdaq",
]
COMMON_TICKERS = ["NOW", "COST", "WELL", "GILD", "COP", "BA", "DE", "GE", "KO", "MS", "PM", "CB", "V", "ALL", "ARE"]
TEMPLATE = (
    r"(?:shares (?:sold|bought|purchased|acquired) by|shares (?:in|of) .{0,80}(?:acquired|sold|bought|purchased) by"
    r"|(?:acquires?|buys?|sells?|purchases?|trims?|cuts?|lowers?|raises?|boosts?|increases?|decreases?|reduces?|grows?|lifts?)"
    r" (?:\$[\d.,]+ (?:million|billion) |new |[\d,]+ shares (?:of|in) |its )?(?:stake|position|holdings?|shares)\b"
    r"|(?:stake|position|holdings?) (?:in|raised|lowered|boosted|trimmed|cut|increased|decreased|reduced|lifted)\b"
    r"|has \$[\d.,]+ (?:million|billion|thousand)|invests? \$[\d.,]+ (?:million|billion|thousand) in|stock position"
    r"|takes position in|(?:sells?|buys?) [\d,]+ shares|sells? \$[\d.,]+ in stock|insider (?:selling|buying|sells|buys)"
    r"|short interest|stocks to (?:add|watch|buy)|watchlist)"
)
EVENTS = {
    "earn": r"\b(?:earnings|eps|quarterly (?:results|profit|revenue)|q[1-4] (?:results|earnings|revenue|sales)|beats?|miss(?:es|ed)?|profit (?:rises|falls|jumps|drops))\b",
    "guid": r"\b(?:guidance|outlook|forecasts?|raises? (?:its )?(?:full-year|annual|outlook|forecast)|cuts? (?:its )?(?:outlook|forecast))\b",
    "anal": r"\b(?:upgraded?s?|downgraded?s?|price target|initiates? coverage|reiterates?|overweight|underweight|outperform|underperform)\b",
    "legal": r"\b(?:lawsuit|sued?s?|probe|investigation|settles?|settlement|fined?|antitrust|subpoena|recalls?|indicted|charges filed)\b",
    "mna": r"\b(?:acquisition|acquires?|to acquire|merger|merges?|buyout|takeover|deal to buy|spin-?off|divest\w*)\b",
    "prod": r"\b(?:launch\w*|unveil\w*|fda|approv\w+|clinical trial|patent|rollout|release[sd]? new)\b",
    "mgmt": r"\b(?:ceo|cfo|chief executive|resign\w*|steps? down|appoint\w*|succeed\w*|layoffs?|job cuts)\b",
}
VEC_TOKEN = r"\$?[A-Za-z]+(?:[.'&-][A-Za-z]+)*|\d+(?:[.,]\d+)*%?"
NOT_TITLE = "[^a-z0-9]+"
SOURCE_TAIL = r"\s+[-|–—]\s+[^-|–—]{1,40}$"
CONTENT_WORD = r"[a-z][a-z'&-]+"
CASHTAG = r"\$([A-Za-z]{1,5}(?:[./-][A-Za-z])?)\b"
BARE_TICKER = r"\b([A-Z]{3,5}(?:[./-][A-Z])?)\b"
HIDDEN_TAG = r"\$[A-Za-z]{1,5}(?:[.\-][A-Za-z])?\b"
NUMBER = r"[-+−]?\d+(?:[.,]\d+)*%?"
MONTHS = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
DATES = rf"\b{MONTHS}\.?\s*\d{{0,2}}(?:,?\s*\d{{4}})?\b|\b(?:19|20)\d{{2}}\b|\b\d{{1,2}}/\d{{1,2}}(?:/\d{{2,4}})?\b|\b(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day\b"


def normal_title(title: Column) -> Column:
    """Lower-case letters and digits, everything else one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), NOT_TITLE, " "))


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x) if isinstance(x, str) else "")


def clean_title(title: Column) -> Column:
    """HTML entities decoded, a source of up to 40 characters after the last dash or bar cut off."""
    text = F.when(F.instr(title, "&") > 0, _unescape(title)).otherwise(F.coalesce(title, F.lit("")))
    return F.trim(F.regexp_replace(text, SOURCE_TAIL, ""))


def title_id(title: Column) -> Column:
    return F.md5(normal_title(title))


def cluster_key(title: Column) -> Column:
    """Equal for titles of the same content words, whatever their order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(CONTENT_WORD), F.lit(0))
    return F.md5(F.array_join(F.array_sort(F.array_distinct(F.array_except(words, F.array(*map(F.lit, STOPWORDS))))), " "))


def is_template(title: Column) -> Column:
    return F.coalesce(title.rlike(f"(?iU){TEMPLATE}"), F.lit(False)).cast("int")


def event_flags(title: Column) -> dict[str, Column]:
    low = F.lower(F.coalesce(title, F.lit("")))
    return {f"ev_{name}": low.rlike(f"(?U){pattern}").cast("int") for name, pattern in EVENTS.items()}


def symbol_pattern(symbol: str, names: list[str] = ()) -> str:
    """What points to a symbol: its cashtag, its bare ticker unless that is a common word or short, its names."""
    parts = [rf"\${re.escape(symbol)}\b"]
    if symbol not in COMMON_TICKERS and len(symbol) > 2:
        parts.append(rf"\b{re.escape(symbol)}\b")
    parts += [rf"(?i:(?<!\w){re.escape(n)}(?:'s)?(?!\w))" for n in sorted(names, key=len, reverse=True)]
    return "|".join(parts)


def company_names(spark, names: dict[str, list[str]]) -> DataFrame:
    """``(ticker, word, pattern)`` of companies and their names: a row for each first word that the pattern can begin with.

    A table of companies, as large as its dictionary; keys that begin with ``_`` are remarks.
    """
    rows = set()
    for ticker, own in names.items():
        if not ticker.startswith("_"):
            for name in (ticker, *own):
                word = (re.findall("[a-z0-9]+", name.lower()) or [""])[0]
                rows.add((ticker, word, symbol_pattern(ticker, list(own))))
    return spark.createDataFrame(sorted(rows), "ticker string, word string, pattern string")


def first_words(title: Column) -> Column:
    """What a name in a title may begin with: runs of letters, with and without digits, and nothing (names in no ASCII)."""
    runs = [F.regexp_extract_all(F.lower(title), F.lit(x), F.lit(0)) for x in ("[a-z]+", "[a-z0-9]+")]
    return F.array_distinct(F.concat(*runs, F.array(F.lit(""))))


def words_of(title: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)), F.upper)


def lexicon_scores(title: Column, positive: list[str], negative: list[str], uncertain: list[str]) -> tuple[Column, Column]:
    """Net tone and uncertainty a word; a positive word counts as negative within three words after a negator."""
    words = words_of(title)
    lits = lambda xs: F.array(*[F.lit(x.upper()) for x in xs])
    at = F.transform(words, lambda x, i: F.struct(x.alias("w"), F.arrays_overlap(F.slice(words, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), lits(NEGATORS)).alias("no")))
    count = lambda f: F.size(F.filter(at, f)).cast("double")
    has = lambda x, xs: F.array_contains(lits(xs), x["w"])
    good = count(lambda x: has(x, positive) & ~x["no"])
    bad = count(lambda x: (has(x, positive) & x["no"]) | (~has(x, positive) & has(x, negative)))
    n = F.nullif(F.size(words), F.lit(0))
    return (good - bad) / n, count(lambda x: has(x, uncertain)) / n


def mentions(body: Column) -> Column:
    """Tickers a text mentions: cashtags in any case, bare ones in capitals unless common or short; no repeats."""
    text = F.coalesce(body, F.lit(""))
    tidy = lambda x: F.regexp_replace(F.upper(x), "[./]", "-")
    tags = F.transform(F.regexp_extract_all(text, F.lit(CASHTAG), F.lit(1)), tidy)
    bare = F.transform(F.regexp_extract_all(text, F.lit(BARE_TICKER), F.lit(1)), tidy)
    return F.array_distinct(F.concat(tags, F.array_except(bare, F.array(*map(F.lit, COMMON_TICKERS)))))


def anonymize(text: Column, aliases: dict[str, list[str]], target: str | None = None) -> Column:
    """Companies and dates replaced: ``[COMPANY]`` (or ``[TARGET]`` and ``[OTHER]``) and ``[DATE]``; blanks squeezed."""
    own = set(aliases.get(target, ())) if target else set()
    mark = lambda mine: "[COMPANY]" if target is None else "[TARGET]" if mine else "[OTHER]"
    out = F.coalesce(text, F.lit(""))
    if target:
        out = F.regexp_replace(out, rf"(?i)\${re.escape(target)}\b", "[TARGET]")
    out = F.regexp_replace(out, HIDDEN_TAG, mark(False))
    for name in sorted({n for v in aliases.values() for n in v}, key=lambda n: (-len(n), n)):
        out = F.regexp_replace(out, rf"(?i)(?<!\w){re.escape(name)}(?:'s)?(?!\w)", mark(name in own))
    for ticker in sorted(aliases):
        out = F.regexp_replace(out, rf"\b{re.escape(ticker)}\b", mark(ticker == target))
    return F.trim(F.regexp_replace(F.regexp_replace(out, f"(?i){DATES}", "[DATE]"), r"\s+", " "))


def unknown_numbers(prompt: Column, text: Column) -> Column:
    """Numbers of a text that its prompt doesn't have, signs, separators and percent marks aside."""
    number = F.lit(NUMBER)
    plain = lambda x: F.regexp_replace(F.regexp_replace(F.replace(F.replace(x, F.lit("−"), F.lit("-")), F.lit(","), F.lit("")), "%$", ""), r"^\++", "")
    have = F.transform(F.regexp_extract_all(prompt, number, F.lit(0)), plain)
    return F.filter(F.regexp_extract_all(text, number, F.lit(0)), lambda x: ~F.array_contains(have, plain(x)))


def terms_of(kind: str, column: str) -> Column:
    """The terms of a text that a vectorizer counts, repeats included."""
    low = F.lower(F.coalesce(F.col(column), F.lit("")))
    words = F.regexp_extract_all(low, F.lit(f"(?U){VEC_TOKEN}"), F.lit(0))
    if kind == "tfidf_stop":
        return F.filter(words, lambda w: ~w.isin([w for w in STOPWORDS if w not in NEGATORS]))
    if kind == "tfidf_bi":
        pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.concat(words, pairs)
    if kind == "tfidf_char":
        # runs of 3 to 5 characters within a word and its blanks; a word shorter than a run counts whole, once
        padded = F.transform(F.filter(F.split(low, r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
        runs = lambda w, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))
        of = lambda w: F.concat(*[F.when((F.lit(n) == 3) | (F.length(w) >= n), runs(w, n)).otherwise(F.array().cast("array<string>")) for n in (3, 4, 5)])
        return F.flatten(F.transform(padded, of))
    return words


#: Vectorizers by name: whether terms are weighted, and the least and most titles a term may be in where not given.
VECTORIZERS = {"count_uni": (False, 5, 1.0), "tfidf_uni": (True, 5, 1.0), "tfidf_bi": (True, 5, 1.0), "tfidf_char": (True, 5, 1.0), "tfidf_stop": (True, 5, 1.0), "tfidf_df": (True, 20, 0.5), "lm_vocab": (False, 1, 1.0), "hashing": (False, 1, 1.0)}


class Vectorizer:
    """Sparse vectors of a text column, as ``features``.

    count_uni: counts of words. tfidf_*: 1 + ln(count), times ln((1 + n) / (1 + df)) + 1, at length 1; of words, words and
    pairs (bi), characters within words (char), words but common ones (stop), words neither rare nor common (df).
    lm_vocab: counts of a given lexicon's words. hashing: hashed counts at length 1, nothing learnt.
    A text that is null or has no known term is a vector of zeros. All terms between min_df and max_df are kept, unless ``most``
    bounds the vocabulary (the most frequent first); the vocabulary is held by the driver and every executor.
    """

    def __init__(self, kind: str, column: str = "title", min_df: int | None = None, max_df: float | None = None, features: int = 1 << 18, lexicon: list[str] | None = None, most: int | None = None):
        if kind not in VECTORIZERS:
            raise ValueError(f"vectorizer: {kind} is none of {', '.join(VECTORIZERS)}")
        if kind == "lm_vocab" and not lexicon:
            raise ValueError("lm_vocab needs the words of a lexicon")
        weighted, low, high = VECTORIZERS[kind]
        self.kind, self.column, self.weighted = kind, column, weighted
        self.min_df, self.max_df = min_df or low, max_df or high
        self.features, self.lexicon, self.most = features, lexicon, most
        self.counts, self.idf = None, None

    def fit(self, df: DataFrame) -> Vectorizer:
        from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, HashingTF

        rows = df.select(terms_of(self.kind, self.column).alias("_terms"))
        if self.kind == "hashing":
            self.counts = HashingTF(inputCol="_terms", outputCol="_n", numFeatures=self.features)
        elif self.kind == "lm_vocab":
            self.counts = CountVectorizerModel.from_vocabulary(sorted({w.lower() for w in self.lexicon}), inputCol="_terms", outputCol="_n")
        else:
            at_most = float(self.max_df) if self.max_df != 1.0 else float(1 << 62)
            self.counts = CountVectorizer(inputCol="_terms", outputCol="_n", minDF=float(self.min_df), maxDF=at_most, vocabSize=self.most or (1 << 31) - 1).fit(rows)
        if self.weighted:
            self.idf = (IDF(inputCol="_n", outputCol="_i").fit(self.counts.transform(rows)).idf.toArray() + 1.0).tolist()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import ElementwiseProduct, Normalizer
        from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT

        out = self.counts.transform(df.withColumn("_terms", terms_of(self.kind, self.column))).drop("_terms")
        if self.weighted:
            # the counts as a row of their own: a Python function over the terms' nested lambdas was at times left in the
            # plan unevaluated ("Cannot evaluate expression"); over a column of the row below it never is
            out = out.select(*[c for c in out.columns if c != "_n"], F.explode(F.array("_n")).alias("_n"))
            # MLlib has no logarithm of a sparse vector
            log = F.udf(lambda v: SparseVector(v.size, v.indices, 1 + np.log(v.values)), VectorUDT())
            out = ElementwiseProduct(inputCol="_l", outputCol="_w", scalingVec=Vectors.dense(self.idf)).transform(out.withColumn("_l", log("_n")))
            return Normalizer(inputCol="_w", outputCol="features").transform(out).drop("_n", "_l", "_w")
        if self.kind == "hashing":
            return Normalizer(inputCol="_n", outputCol="features").transform(out).drop("_n")
        return out.withColumnRenamed("_n", "features")


def explode_symbols(news: DataFrame) -> DataFrame:
    return news.withColumn("symbol", F.explode(F.split(F.coalesce("symbols", F.lit("")), ",")))
