"""Scores and decision rules.

Every search first lowers signals to the nearest place where some candidate would decide differently, counts rows by that
place and label, and only then expands the grid: what a candidate costs does not depend on the number of rows. (Regimes
scale a signal by the day, so theirs are counted by distinct value.) Ties go to the first candidate in grid order; a null
score loses.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foreopen.sources.market import label_of

CUTS = (-2.5, -0.6, 0.6, 2.5)


def weight(y: Column, q: Column) -> Column:
    """Cost of predicting q for truth y: squared distance times squared distance of the truth from flat."""
    return (y - q) * (y - q) * (y - 2) * (y - 2)


def counts(df: DataFrame, *keys: str, label: str = "label", pred: str = "pred", n: Column | None = None) -> DataFrame:
    return df.groupBy(*keys, F.col(label).alias("y"), F.col(pred).alias("q")).agg((F.count("*") if n is None else F.sum(n)).alias("o"))


def score_counts(c: DataFrame, *keys: str) -> DataFrame:
    """``score`` of counts ``(keys, y, q, o)``: 1 less observed cost over the cost of independence; null without cost.

    Truths and predictions have five values, so the marginals are five sums each.
    """
    rows = [F.sum(F.when(F.col("y") == i, F.col("o")).otherwise(0)).alias(f"r{i}") for i in range(5)]
    cols = [F.sum(F.when(F.col("q") == j, F.col("o")).otherwise(0)).alias(f"k{j}") for j in range(5)]
    cost = F.sum(weight(F.col("y"), F.col("q")) * F.col("o")).cast("double").alias("num")
    g = c.groupBy(*keys).agg(cost, F.sum("o").alias("n"), *rows, *cols)
    den = sum((F.col(f"r{i}") * F.col(f"k{j}") * float((i - j) ** 2 * (i - 2) ** 2) for i in range(5) for j in range(5) if i != j and i != 2), F.lit(0.0)) / F.col("n")
    return g.select(*keys, "n", (1 - F.try_divide(F.col("num"), den)).alias("score"))


def score(df: DataFrame, *keys: str, label: str = "label", pred: str = "pred") -> DataFrame:
    """``n, score, accuracy, direction, big_recall, big_prec`` by keys. direction: of truths that aren't flat."""
    t, p = F.col("y"), F.col("q")
    c = counts(df, *keys, label=label, pred=pred)
    o = F.col("o")
    share = lambda hit, of: F.try_divide(F.sum(F.when(hit & of, o).otherwise(0)), F.sum(F.when(of, o).otherwise(0)))
    big_t, big_p = t.isin(0, 4), p.isin(0, 4)
    more = c.groupBy(*keys).agg(
        share(t == p, F.lit(True)).alias("accuracy"), share(F.signum(t - 2) == F.signum(p - 2), t != 2).alias("direction"),
        share(t == p, big_t).alias("big_recall"), share(t == p, big_p).alias("big_prec"),
    )
    base = score_counts(c, *keys)
    return base.join(more, list(keys)) if keys else base.crossJoin(more)


def score_more(df: DataFrame, *keys: str) -> DataFrame:
    """Magnitude accuracy, flips and extremes by keys, with the score's loss by true class (their sum is 1 - score)."""
    c = counts(df, *keys)
    t, p, o = F.col("y"), F.col("q"), F.col("o")
    n = F.sum("o")
    sum_if = lambda cond, x=o: F.sum(F.when(cond, x).otherwise(0))
    flip = ((t == 0) & (p == 4)) | ((t == 4) & (p == 0))
    cost = (weight(t, p) * o).cast("double")
    rate = lambda i, j: F.coalesce(F.try_divide(sum_if((t == i) & (p == j)), sum_if(t == i)), F.lit(0.0))
    base = c.groupBy(*keys).agg(
        (sum_if(F.abs(t - 2) == F.abs(p - 2)) / n).alias("magnitude_acc"), (sum_if(flip) / n).alias("flip_index"), (rate(0, 4) + rate(4, 0)).alias("flip_rate"),
        F.try_divide(F.sum(F.when(flip, cost).otherwise(0.0)), F.sum(cost)).alias("flip_loss_share"),
        (sum_if(p.isin(0, 4)) / n).alias("pred_extreme"), (sum_if(t.isin(0, 4)) / n).alias("true_extreme"),
        *[F.sum(F.when(t == i, cost).otherwise(0.0)).alias(f"l{i}") for i in range(5)], F.sum(cost).alias("cost"),
    )
    got = base.join(score_counts(c, *keys), list(keys)) if keys else base.crossJoin(score_counts(c))
    loss = lambda i: (F.try_divide(F.col(f"l{i}"), F.col("cost")) * (1 - F.col("score"))).alias(f"loss_c{i}")
    return got.select(*keys, "magnitude_acc", "flip_index", "flip_rate", "flip_loss_share", "pred_extreme", "true_extreme", *[loss(i) for i in range(5)])


def by_bounds(s: Column, bounds) -> Column:
    """How many bounds are at or under s; flat for null."""
    total = F.lit(0)
    for b in bounds:
        total = total + (s >= (b if isinstance(b, Column) else F.lit(float(b)))).cast("int")
    return F.coalesce(total, F.lit(2))


def k_rule(s: Column, k_up: Column | float, k_down: Column | float | None = None) -> Column:
    """Classes of k times s, with factors for rises and falls."""
    k_down = k_up if k_down is None else k_down
    up, down = (k if isinstance(k, Column) else F.lit(float(k)) for k in (k_up, k_down))
    return by_bounds(s, [F.lit(-2.5) / down, F.lit(-0.6) / down, F.lit(0.6) / up, F.lit(2.5) / up])


def k_grid(spark, low: float = 0.5, high: float = 8.0, step: float = 0.25) -> DataFrame:
    n = int(round((high - low) / step)) + 1
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(low) + F.col("id") * step).alias("k"))


def compress(df: DataFrame, signal: str = "s", label: str = "label", *keys: str) -> DataFrame:
    """Distinct (keys, signal, label) with their number: what a grid needs of the rows."""
    return df.where(F.col(label).isNotNull()).groupBy(*keys, F.col(signal).alias("s"), F.col(label).alias("y")).agg(F.count("*").alias("o"))


def lowered(x: Column, edges: Column) -> Column:
    """The largest edge at or under x, minus infinity under all: ``lowered(x) >= e`` just where ``x >= e`` for every edge."""
    low = F.array_max(F.filter(edges, lambda e: e <= x))
    return F.when(x.isNotNull(), F.coalesce(low, F.lit(-math.inf)))


def k_edges(grid: DataFrame) -> DataFrame:
    """All places where some factor's class changes, as one row ``edges``; a grid is a few dozen rows."""
    cuts = F.explode(F.array(*[F.lit(c) / F.col("k") for c in CUTS]))
    return grid.select(cuts.alias("e")).agg(F.array_sort(F.collect_set("e")).alias("edges"))


def by_edges(df: DataFrame, edges: DataFrame, signal: str, *keys: str, label: str = "label") -> DataFrame:
    """``compress`` of a signal lowered to edges: at most (edges + 2) times 5 rows by keys."""
    own = df.where(F.col(label).isNotNull()).crossJoin(F.broadcast(edges)).withColumn("s", lowered(F.col(signal).cast("double"), F.col("edges")))
    return own.groupBy(*keys, "s", F.col(label).alias("y")).agg(F.count("*").alias("o"))


def scan(rows: DataFrame, grid: DataFrame, pred: Column, *keys: str) -> DataFrame:
    """Score of every grid row: the grid (small, of fixed size) is broadcast, predictions are columns."""
    got = rows.crossJoin(F.broadcast(grid)).withColumn("q", pred).groupBy(*keys, *grid.columns, "y", "q").agg(F.sum("o").alias("o"))
    return score_counts(got, *keys, *grid.columns)


def winner(scored: DataFrame, *keys: str, order: tuple[str, ...] = ("i",)) -> DataFrame:
    """The first grid row of the highest score; null scores lose."""
    rank = Window.partitionBy(*keys).orderBy(F.col("score").desc_nulls_last(), *order)
    return scored.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")


def fit_k(df: DataFrame, *keys: str, signal: str = "s") -> tuple[DataFrame, DataFrame]:
    """Scores of all factors, and the best."""
    spark = df.sparkSession
    grid = k_grid(spark)
    scored = scan(by_edges(df, k_edges(grid), signal, *keys), grid, k_rule(F.col("s"), F.col("k")), *keys)
    return scored, winner(scored, *keys)


def fit_asym(df: DataFrame, signal: str = "s", **grid) -> DataFrame:
    """Best factors for rises and falls; the grid runs over falls first.

    The two sides share no rows, so counts are taken of each side and factor, and pairs are formed of counts alone.
    """
    spark = df.sparkSession
    g = k_grid(spark, **grid)
    edges = k_edges(g).select(F.array_sort(F.array_union("edges", F.array(F.lit(0.0)))).alias("edges"))
    rows = by_edges(df, edges, signal).withColumn("side", F.coalesce(F.col("s") >= 0, F.lit(True)))
    part = rows.crossJoin(F.broadcast(g)).withColumn("q", k_rule(F.col("s"), F.col("k"))).groupBy("side", "i", "k", "y", "q").agg(F.sum("o").alias("o"))
    other = g.select(F.col("i").alias("j"), F.col("k").alias("k2"))
    up = part.where("side").crossJoin(F.broadcast(other)).select(F.col("i").alias("iu"), F.col("k").alias("k_up"), F.col("j").alias("id"), F.col("k2").alias("k_dn"), "y", "q", "o")
    down = part.where("not side").crossJoin(F.broadcast(other)).select(F.col("j").alias("iu"), F.col("k2").alias("k_up"), F.col("i").alias("id"), F.col("k").alias("k_dn"), "y", "q", "o")
    return winner(score_counts(up.union(down), "iu", "id", "k_up", "k_dn"), order=("iu", "id"))


def fit_sym2(df: DataFrame, signal: str = "s") -> DataFrame:
    """Best two thresholds on the size of s, among its quantiles from 5 % to 98 % in steps of 3 %."""
    levels = [round(0.05 + 0.03 * i, 3) for i in range(32)]
    size = F.abs(F.col(signal))
    cuts = df.agg(F.array_sort(F.array_distinct(F.percentile(size, F.array(*map(F.lit, levels))))).alias("c"))
    rows = by_edges(df, cuts.select(F.array_sort(F.concat("c", F.transform("c", lambda e: -e))).alias("edges")), signal)
    cuts = cuts.select(F.posexplode("c").alias("i", "a"))
    pairs = cuts.crossJoin(cuts.select(F.col("i").alias("j"), F.col("a").alias("b"))).where("i < j")
    s = F.col("s")
    return winner(scan(rows, pairs, by_bounds(s, [-F.col("b"), -F.col("a"), F.col("a"), F.col("b")])), order=("i", "j"))


def _fast_score(o: np.ndarray) -> float:
    w = np.array([[(i - j) ** 2 * (i - 2) ** 2 for j in range(5)] for i in range(5)], float)
    e = (w * np.outer(o.sum(1), o.sum(0))).sum() / max(o.sum(), 1)
    return 1 - (w * o).sum() / e if e else -math.inf


def fit_four(df: DataFrame, signal: str = "s", levels: int = 80, passes: int = 3) -> list[float]:
    """Four free bounds by coordinate descent from the best two factors, over quantiles of s.

    The driver sees only the counts of each label between neighbouring candidates: at most ``5 * (levels + 9)`` numbers.
    """
    best = fit_asym(df, signal).first()
    bounds = [CUTS[0] / best["k_dn"], CUTS[1] / best["k_dn"], CUTS[2] / best["k_up"], CUTS[3] / best["k_up"]]
    q = df.agg(F.percentile(signal, F.array(*[F.lit(float(x)) for x in np.linspace(0.005, 0.995, levels)])).alias("c")).first()["c"]
    edges = np.unique([*(q or []), *bounds])
    bin_ = F.expr(f"aggregate(array({', '.join(f'{float(e)!r}D' for e in edges)}), 0, (n, e) -> n + if(s >= e, 1, 0))")
    table, flat = np.zeros((len(edges) + 1, 5)), np.zeros(5)
    for r in compress(df, signal).withColumn("b", F.when(F.col("s").isNotNull(), bin_)).groupBy("b", "y").agg(F.sum("o").alias("o")).collect():
        if r["b"] is None:
            flat[r["y"]] += r["o"]
        else:
            table[r["b"], r["y"]] += r["o"]

    def value(bs: list[float]) -> float:
        o = np.zeros((5, 5))
        at = [0, *[int(np.searchsorted(edges, b)) + 1 for b in bs], len(table)]
        for k in range(5):
            o[:, k] += table[at[k] : max(at[k], at[k + 1])].sum(0)
        o[:, 2] += flat
        return _fast_score(o)

    for _ in range(passes):
        for k in range(4):
            low, high = bounds[k - 1] if k else -math.inf, bounds[k + 1] if k < 3 else math.inf
            options = [c for c in np.unique(q or []) if low < c < high] + [bounds[k]]
            bounds[k] = float(max(options, key=lambda c: value(bounds[:k] + [c] + bounds[k + 1 :])))  # noqa: B023
    return bounds


def decomposed(p_move: Column, p_ext: Column, p_up: Column, t_move: Column | float, t_ext: Column | float, c: Column | float = 0.0) -> Column:
    """Flat under t_move; else extreme from t_ext on (if the direction is at least c from even), else small."""
    return _decomposed(p_move, p_ext, p_up >= 0.5, F.abs(p_up - 0.5), t_move, t_ext, c)


def _decomposed(p_move: Column, p_ext: Column, up: Column, sure: Column, t_move, t_ext, c) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    ext = (p_ext >= lit(t_ext)) & (sure >= lit(c))
    return F.when(p_move < lit(t_move), 2).when(up & ext, 4).when(up, 3).when(ext, 0).otherwise(1)


def fit_decomposed(df: DataFrame, gate: bool = False) -> DataFrame:
    """Best thresholds over quantiles of p_move and p_ext, and of the gate where asked for."""
    levels = F.array(*[F.lit(round(0.05 * i, 2)) for i in range(1, 20)])
    q = df.agg(F.array_sort(F.array_distinct(F.percentile("p_move", levels))).alias("m"), F.array_sort(F.array_distinct(F.percentile("p_ext", levels))).alias("e"))
    gates = [0.0, 0.05, 0.1, 0.15, 0.2, 0.3] if gate else [0.0]
    grid = q.select(F.posexplode("m").alias("i", "t_move"), "e").select("i", "t_move", F.posexplode("e").alias("j", "t_ext"))
    grid = grid.select("*", F.posexplode(F.array(*map(F.lit, gates))).alias("l", "c"))
    own = df.where("label is not null").crossJoin(F.broadcast(q))
    own = own.select(lowered(F.col("p_move"), F.col("m")).alias("p_move"), lowered(F.col("p_ext"), F.col("e")).alias("p_ext"), (F.col("p_up") >= 0.5).alias("up"), lowered(F.abs(F.col("p_up") - 0.5), F.array(*map(F.lit, gates))).alias("sure"), F.col("label").alias("y"))
    rows = own.groupBy(*own.columns).agg(F.count("*").alias("o"))
    pred = _decomposed(F.col("p_move"), F.col("p_ext"), F.col("up"), F.col("sure"), F.col("t_move"), F.col("t_ext"), F.col("c"))
    return winner(scan(rows, grid, pred), order=("i", "j", "l"))


# regimes: the size of a signal scaled by the day's market


def tercile_edges(df: DataFrame, var: str) -> DataFrame:
    """Terciles of a day variable's distinct values."""
    return df.select(var).where(F.col(var).isNotNull()).distinct().agg(F.percentile(var, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("e")).select(F.get("e", F.lit(0)).alias("e1"), F.get("e", F.lit(1)).alias("e2"))


def fit_tercile(df: DataFrame, var: str, k: float, signal: str = "s") -> DataFrame:
    """Best factors of the low and the high third, 0.6 to 1.6 each; a null day value counts as the batch's median."""
    spark = df.sparkSession
    edges = tercile_edges(df, var).crossJoin(df.agg(F.median(var).alias("med")))
    r = F.coalesce(F.col(var), F.col("med"), F.lit(0.0))
    third = F.when(r < F.col("e1"), 0).when(r < F.col("e2"), 1).otherwise(2)
    rows = df.crossJoin(F.broadcast(edges)).withColumn("third", third).where("label is not null")
    rows = rows.groupBy("third", F.col(signal).alias("s"), F.col("label").alias("y")).agg(F.count("*").alias("o"))
    f = spark.range(11).select(F.col("id").alias("i"), F.round(F.lit(0.6) + F.col("id") * 0.1, 3).alias("f_lo"))
    grid = f.crossJoin(f.select(F.col("i").alias("j"), F.col("f_lo").alias("f_hi")))
    scaled = F.col("s") * F.when(F.col("third") == 0, F.col("f_lo")).when(F.col("third") == 2, F.col("f_hi")).otherwise(1.0)
    return winner(scan(rows, grid, k_rule(scaled, k)), order=("i", "j")).crossJoin(edges.select("e1", "e2"))


def fit_linear(df: DataFrame, var: str, k: float, signal: str = "s") -> DataFrame:
    """Best slope a, -1 to 1, of the factor exp(a * (r - median) / iqr) kept within 0.5 and 2."""
    spark = df.sparkSession
    days = df.select(var).where(F.col(var).isNotNull()).distinct()
    stats = days.agg(F.median(var).alias("med"), F.percentile(var, F.array(F.lit(0.25), F.lit(0.75))).alias("q")).select("med", F.coalesce(F.nullif(F.get("q", F.lit(1)) - F.get("q", F.lit(0)), F.lit(0.0)), F.lit(1.0)).alias("iqr"))
    z = F.coalesce((F.col(var) - F.col("med")) / F.col("iqr"), F.lit(0.0))
    rows = df.crossJoin(F.broadcast(stats)).withColumn("z", z).where("label is not null").groupBy("z", F.col(signal).alias("s"), F.col("label").alias("y")).agg(F.count("*").alias("o"))
    grid = spark.range(21).select(F.col("id").alias("i"), F.round(F.lit(-1.0) + F.col("id") * 0.1, 3).alias("a"))
    factor = F.greatest(F.least(F.exp(F.col("a") * F.col("z")), F.lit(2.0)), F.lit(0.5))
    return winner(scan(rows, grid, k_rule(F.col("s") * factor, k))).crossJoin(stats)


def objective(df: DataFrame, chunks: int, kind: str = "mean") -> DataFrame:
    """One figure over equal spans of target days: pooled, mean, mean less standard deviation, or the least."""
    if kind == "pooled":
        return score_counts(counts(df)).select("score")
    days = df.select("target").distinct()
    span = days.withColumn("chunk", F.ntile(chunks).over(Window.orderBy("target")))
    own = score_counts(counts(df.join(F.broadcast(span), "target"), "chunk"), "chunk")
    agg = {"mean": F.avg("score"), "mean_sd": F.avg("score") - F.stddev_pop("score"), "min": F.min("score")}[kind]
    return own.agg(agg.alias("score"))


def baselines(df: DataFrame) -> DataFrame:
    """Scores of strategies that know nothing, the direction, the extremes or everything."""
    y = F.col("label")
    big = y.isin(0, 4)
    named = {"flat": F.lit(2), "surge": F.lit(4), "direction": F.when(y < 2, 1).when(y > 2, 3).otherwise(2), "extremes": F.when(big, y).otherwise(2), "flipped": F.when(big, 4 - y).otherwise(2), "perfect": y}
    c = df.groupBy(F.col("label").alias("label")).agg(F.count("*").alias("o"))
    rows = c.select(F.col("label").alias("y"), "o", F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), v.cast("int").alias("q")) for k, v in named.items()])).alias("p")).select("p.strategy", "y", "p.q", "o")
    return score_counts(rows, "strategy").select("strategy", "n", "score")


def flat_rows(df: DataFrame, shares=(0.0, 0.05, 0.1, 0.2, 0.4), key: str = "event_id") -> DataFrame:
    """The extremes oracle's score when a share of truly flat rows, in order of a hash, is called surge."""
    flat = df.where("label = 2").withColumn("u", F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0)
    c = df.where("label <> 2").groupBy("label").agg(F.count("*").alias("o")).select(F.col("label").alias("y"), F.when(F.col("label").isin(0, 4), F.col("label")).otherwise(2).alias("q"), "o")
    share = F.explode(F.array(*map(F.lit, shares))).alias("share")
    rest = flat.select("u", share).groupBy("share", F.when(F.col("u") < F.col("share"), 4).otherwise(2).alias("q")).agg(F.count("*").alias("o")).select("share", F.lit(2).alias("y"), "q", "o")
    return score_counts(c.select(share, "y", "q", "o").unionByName(rest), "share").select("share", "score")


def cost_min(probabilities: list[Column]) -> Column:
    """The prediction of least expected cost from five class probabilities; the smaller on ties."""
    cost = [sum((p * float((i - j) ** 2 * (i - 2) ** 2) for i, p in enumerate(probabilities)), F.lit(0.0)) for j in range(5)]
    return F.array_position(F.array(*cost), F.array_min(F.array(*cost))).cast("int") - 1


@dataclass
class Spec:
    """A candidate: its signal, rule and regime by name, and how it is tuned."""

    name: str
    signal: str = "column"
    decision: str = "k"
    regime: str = "none"
    features: tuple[str, ...] = ("gap_pct",)
    params: dict = field(default_factory=dict)
    tune_share: float = 0.2
    seed: int = 0

    def check(self) -> Spec:
        for value, known in ((self.signal, SIGNALS), (self.decision, DECISIONS), (self.regime, REGIMES)):
            if value not in known:
                raise ValueError(f"{self.name}: {value} is none of {', '.join(known)}")
        if (self.signal == "decomp") != (self.decision == "decomp"):
            raise ValueError(f"{self.name}: the decomp signal and decision go together")
        return self


SIGNALS = ("column", "regress", "classify5", "decomp")
DECISIONS = ("flat", "identity", "k", "sym2", "asym", "4t", "decomp")
REGIMES = ("none", "tercile", "linear", "textclf")
#: Where a text regime puts its probability of a big move.
BIG = "_p_big"


class BigMove:
    """Probability that a row's move is extreme, from its titles or from columns: balanced logistic regression.

    params: input ("text" or "columns"), vectorizer, min_df, max_df, lexicon, columns, C (inverse strength of the
    penalty). Rows without titles have no probability; missing numbers are their column's median. Where all rows learnt
    from are of one kind, or there are none, that share (or an even chance) is every row's probability.
    """

    def __init__(self, params: dict):
        self.text = params.get("input", "text") == "text"
        self.params, self.vectors, self.classifier, self.middle, self.share = params, None, None, {}, 0.5

    def _inputs(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        if self.text:
            return self.vectors.transform(df)
        names = list(self.middle)
        filled = df.withColumns({f"_{c}": (F.coalesce(F.col(c).cast("double"), F.lit(m)) - F.lit(at)) / F.lit(sd) for c, (m, at, sd) in self.middle.items()})
        return VectorAssembler(inputCols=[f"_{c}" for c in names], outputCol="features").transform(filled).drop(*[f"_{c}" for c in names])

    def fit(self, df: DataFrame) -> BigMove:
        from pyspark.ml.classification import LogisticRegression

        df = df.where("label is not null")
        if self.text:
            from foreopen.functions.text import Vectorizer

            df = df.where(F.length("titles_r1") > 0)
            kept = {k: self.params[k] for k in ("min_df", "max_df", "lexicon") if k in self.params}
            self.vectors = Vectorizer(self.params.get("vectorizer", "tfidf_uni"), "titles_r1", **kept).fit(df)
        else:
            for c in self.params["columns"]:
                x = F.col(c).cast("double")
                m = df.agg(F.median(x)).first()[0] or 0.0
                at, sd = df.agg(F.avg(F.coalesce(x, F.lit(m))), F.stddev_pop(F.coalesce(x, F.lit(m)))).first()
                self.middle[c] = (m, at or 0.0, sd or 1.0)
        big = F.col("label").isin(0, 4).cast("double")
        n, hits = df.agg(F.count("*"), F.sum(big)).first()
        if not n or not 0 < hits < n:
            self.share = hits / n if n else 0.5
            return self
        x = self._inputs(df).withColumn("_y", big).withColumn("_w", F.when(big == 1, F.lit(n / (2 * hits))).otherwise(F.lit(n / (2 * (n - hits)))))
        penalty = 1.0 / (float(self.params.get("C", 1.0)) * n)
        self.classifier = LogisticRegression(labelCol="_y", weightCol="_w", regParam=penalty, standardization=False, maxIter=200).fit(x)
        return self

    def terms(self, n: int = 20) -> list[tuple[str, float]]:
        """The inputs that speak most for a big move and most against it, with their coefficients; largest first."""
        if self.classifier is None:
            return []
        names = self.vectors.counts.vocabulary if self.text else list(self.middle)
        ranked = sorted(zip(names, self.classifier.coefficients.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))
        return ranked if len(ranked) <= 2 * n else [*ranked[:n], *ranked[-n:]]

    def values(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        if self.classifier is None:
            return df.withColumn(BIG, F.when(F.length("titles_r1") > 0, self.share) if self.text else F.lit(self.share))
        got = self.classifier.transform(self._inputs(df))
        p = F.get(vector_to_array("probability"), F.lit(1))
        return got.withColumn(BIG, F.when(F.length("titles_r1") > 0, p) if self.text else p).drop("features", "rawPrediction", "probability", "prediction")


class Pipeline:
    """A spec fitted on a panel: signal (learned on early targets), then rule, then regime (tuned on late ones)."""

    def __init__(self, spec: Spec):
        self.spec, self.state, self.model, self.big = spec.check(), {}, None, None

    def _assembled(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        names = list(self.spec.features)
        for c in names:  # a missing value is its column's median, and a flag
            df = df.withColumn(f"_{c}", F.coalesce(F.col(c).cast("double"), F.lit(self.state["medians"].get(c, 0.0)))).withColumn(f"_{c}_no", F.col(c).isNull().cast("double"))
        return VectorAssembler(inputCols=[x for c in names for x in (f"_{c}", f"_{c}_no")], outputCol="_x").transform(df)

    def signal(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        kind = self.spec.signal
        if kind == "column":
            return df.withColumn("s", F.col(self.spec.features[0]).cast("double"))
        x = self._assembled(df)
        drop = ["_x", *[n for c in self.spec.features for n in (f"_{c}", f"_{c}_no")]]
        if kind == "regress":
            return self.model.transform(x).withColumnRenamed("prediction", "s").drop(*drop)
        if kind == "classify5":
            centres = [-4.0, -1.5, 0.0, 1.5, 4.0]
            got = self.model.transform(x).withColumn("_p", vector_to_array("probability"))
            return got.withColumn("s", sum((F.get("_p", F.lit(i)) * c for i, c in enumerate(centres)), F.lit(0.0))).drop("_p", "probability", "rawPrediction", "prediction", *drop)
        for name, m in self.model.items():
            x = m.transform(x).withColumn(name, F.get(vector_to_array("probability"), F.lit(1))).drop("probability", "rawPrediction", "prediction")
        return x.drop(*drop)

    def fit(self, panel: DataFrame) -> Pipeline:
        from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
        from pyspark.ml.regression import GBTRegressor

        spec = self.spec
        train = tune = panel.where("label is not null")
        if spec.signal != "column" or spec.regime == "textclf":
            edge = train.select(F.unix_date("target").alias("t")).distinct().agg(F.percentile("t", F.lit(1 - spec.tune_share))).first()[0]
            late = F.unix_date("target") > F.lit(edge)
            train, tune = train.where(~late), train.where(late)
        if spec.signal != "column":
            row = train.agg(*[F.median(F.col(c).cast("double")).alias(c) for c in spec.features]).first()
            self.state["medians"] = {c: row[c] if row[c] is not None else 0.0 for c in spec.features}
            x = self._assembled(train)
            small = {"maxDepth": 4, "maxIter": int(spec.params.get("trees", 10)), "stepSize": 0.1, "seed": spec.seed, "featuresCol": "_x"}
            if spec.signal == "regress":
                x = x.withColumn("_y", F.greatest(F.least("ret_pct", F.lit(15.0)), F.lit(-15.0)))
                self.model = GBTRegressor(labelCol="_y", lossType="absolute", **small).fit(x)
            elif spec.signal == "classify5":
                self.model = RandomForestClassifier(labelCol="label", featuresCol="_x", numTrees=int(spec.params.get("trees", 20)), maxDepth=6, seed=spec.seed).fit(x)
            else:
                y = F.col("label")
                heads = {"p_move": (x, (y != 2)), "p_ext": (x.where(y != 2), y.isin(0, 4)), "p_up": (x.where(y != 2), y > 2)}
                self.model = {n: GBTClassifier(labelCol="_y", **small).fit(d.withColumn("_y", c.cast("double"))) for n, (d, c) in heads.items()}
        tuned = self.signal(tune)
        rule = spec.decision
        if rule == "k":
            self.state["k"] = float(fit_k(tuned)[1].first()["k"])
        elif rule == "asym":
            best = fit_asym(tuned).first()
            self.state["bounds"] = [CUTS[0] / best["k_dn"], CUTS[1] / best["k_dn"], CUTS[2] / best["k_up"], CUTS[3] / best["k_up"]]
        elif rule == "sym2":
            best = fit_sym2(tuned).first()
            self.state["bounds"] = [-best["b"], -best["a"], best["a"], best["b"]] if best else [-2.5, -0.6, 0.6, 2.5]
        elif rule == "4t":
            self.state["bounds"] = fit_four(tuned)
        elif rule == "decomp":
            best = fit_decomposed(tuned, bool(spec.params.get("gate"))).first()
            self.state |= {n: float(best[n]) for n in ("t_move", "t_ext", "c")}
        if spec.regime != "none":
            var = spec.params.get("var", "reg_med_vol20")
            if spec.regime == "textclf":
                self.big, var = BigMove(spec.params).fit(train), BIG
                tuned = self.big.values(tuned)
            fit = fit_linear if spec.regime == "linear" else fit_tercile
            self.state |= {"var": var} | {n: v for n, v in fit(tuned, var, self.state.get("k", 1.0)).first().asDict().items() if n not in ("n", "score", "i", "j")}
            self.state["batch"] = tuned.agg(F.median(var)).first()[0]
        return self

    def decide(self, s: Column) -> Column:
        rule = self.spec.decision
        if rule == "flat":
            return F.lit(2)
        if rule == "identity":
            return by_bounds(s, CUTS)
        return k_rule(s, self.state["k"]) if rule == "k" else by_bounds(s, self.state["bounds"])

    def predict(self, panel: DataFrame) -> DataFrame:
        """The panel with ``s`` (or three probabilities) and ``pred``; a missing signal is flat."""
        got = self.signal(panel)
        if self.spec.decision == "decomp":
            return got.withColumn("pred", decomposed(F.col("p_move"), F.col("p_ext"), F.col("p_up"), self.state["t_move"], self.state["t_ext"], self.state["c"]))
        s = F.col("s")
        if self.spec.regime == "textclf":
            got = self.big.values(got)
        if self.spec.regime in ("tercile", "textclf"):
            r = F.coalesce(F.col(self.state["var"]), F.lit(self.state["batch"] or 0.0))
            s = s * F.when(r < self.state["e1"], self.state["f_lo"]).when(r < self.state["e2"], 1.0).otherwise(self.state["f_hi"])
        elif self.spec.regime == "linear":
            z = F.coalesce((F.col(self.state["var"]) - self.state["med"]) / self.state["iqr"], F.lit(0.0))
            s = s * F.greatest(F.least(F.exp(self.state["a"] * z), F.lit(2.0)), F.lit(0.5))
        return got.withColumn("s", s).withColumn("pred", self.decide(F.col("s")))


def gap_rule(panel: DataFrame, k: float = 5.25) -> DataFrame:
    """The default rule: classes of k times the gap."""
    return panel.withColumn("pred", F.coalesce(label_of(F.col("gap_pct") * k), F.lit(2)))
