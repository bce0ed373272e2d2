"""Anchors, properties and edge cases of the market operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from foreopen.functions import series as S
from foreopen.functions import text as T
from foreopen.operators import decisions as D
from foreopen.operators import experiments as E
from foreopen.operators import features as X
from foreopen.operators.asof import to_next_cutoff, to_target
from foreopen.sources import market as M


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_label_cuts(spark):
    x = frame(spark, [(v,) for v in (-2.6, -2.5, -0.6, 0.0, 0.6, 2.5, None)], "x double")
    assert [r[0] for r in x.select(M.label_of(F.col("x"))).collect()] == [0, 1, 2, 2, 3, 4, None]


def test_as_of_edges(spark):
    cal = frame(spark, [(dt.date(2024, 1, 5), dt.date(2024, 1, 8)), (dt.date(2024, 1, 8), None)], "date date, target date")
    ev = frame(spark, [(i, t) for i, t in enumerate([dt.datetime(2024, 1, 5, 9, 29), dt.datetime(2024, 1, 5, 9, 30), dt.datetime(2024, 1, 6, 12), dt.datetime(2024, 1, 8, 9, 29, 59), dt.datetime(2024, 1, 8, 9, 30), None])], "i int, t timestamp").withColumn("known_at", F.col("t").cast("timestamp_ntz"))
    got = {r["i"]: r["target"] for r in to_target(ev, cal).collect()}
    assert got == {1: dt.date(2024, 1, 8), 2: dt.date(2024, 1, 8), 3: dt.date(2024, 1, 8)}
    days = frame(spark, [(dt.date(2024, 1, 5),), (dt.date(2024, 1, 8),)], "target date")
    got = {r["i"]: r["target"] for r in to_next_cutoff(ev, days).collect()}
    assert got[0] is None and got[1] == dt.date(2024, 1, 8) and got[4] is None


def test_quantile_bins_of_ties(spark):
    """Edges to the last digit those of the SQL, also between values a last digit apart; one value only is one bin."""
    import duckdb

    rng = np.random.default_rng(0)
    levels = [i / 10 for i in range(11)]
    con = duckdb.connect()
    base = rng.integers(0, 20000, 12) / 100
    noisy = [float((b - 45) / 15 + m / 25 - (m - 3) / 25) for b in base for m in rng.integers(0, 50, 58)]
    x = 25 / 15
    for values in (noisy, [x - 1.0, x, float(np.nextafter(x, 9)), *(x + i for i in range(1, 10))]):
        want = con.execute(f"select list_sort(list_distinct(quantile_cont(s, {levels}))) from (select unnest(?::double[]) as s)", [values]).fetchone()[0]
        some = frame(spark, [(v,) for v in values] + [(None,)], "s double")
        assert E.quantiles(some, "s", levels).first()["_e"] == want
        got = {r["bin"]: r["count"] for r in E.quarter(some, "s", 10).groupBy("bin").count().collect()}
        inner = want[1:-1]
        bins = [sum(v > e for e in inner) for v in values]
        assert got == {None: 1} | {b: bins.count(b) for b in set(bins)}
    same = frame(spark, [(2.5, 1), (2.5, 0)], "s double, y int")
    assert [(r["bin"], r["n"], r["y"]) for r in E.binned(same, "s", "y").collect()] == [(0, 2, 0.5)]
    assert E.binned(same.where("false"), "s", "y").collect() == []


def test_loo_median(spark):
    rows = [("d", s, v) for s, v in zip("abcdef", [1.0, 5.0, None, 2.0, 2.0, 9.0], strict=True)]
    got = {r["s"]: r["m"] for r in S.loo_median(frame(spark, rows, "d string, s string, x double"), "m", F.col("x"), "d", order="s").collect()}
    values = {s: v for _, s, v in rows}
    for s, v in values.items():
        rest = [w for t, w in values.items() if w is not None and (t != s or v is None)]
        assert got[s] == float(np.median(rest))
    few = S.loo_median(frame(spark, rows[:3], "d string, s string, x double"), "m", F.col("x"), "d", order="s")
    assert all(r["m"] is None for r in few.collect())


def test_pct_rank_ties(spark):
    x = frame(spark, [(1, 2.0), (1, 2.0), (1, 5.0), (1, None)], "g int, x double").withColumn("r", S.pct_rank(F.col("x"), "g"))
    assert sorted((r["r"] for r in x.collect()), key=str) == [0.5, 0.5, 1.0, None]


def test_smoothing_skips_nulls(spark):
    x = frame(spark, [("a", i, v) for i, v in enumerate([1.0, None, 3.0, 5.0])], "k string, o int, x double")
    got = [r["s"] for r in S.smooth(x, "k", "o", "x", "s", 0.5).orderBy("o").collect()]
    assert got == [1.0, None, 2.0, 3.5]


def test_smoothing_helpers():
    assert S.alpha_to_span(S.span_to_alpha(20)) == pytest.approx(20)
    assert sum(S.weight_profile(0.5, 40)) == pytest.approx(1)
    assert S.center_of_mass(0.25) == 3


def _pred(spark, pairs):
    return frame(spark, pairs, "label int, pred int")


def test_score_anchors(spark):
    y = [0] * 7 + [1] * 24 + [2] * 33 + [3] * 27 + [4] * 9
    score = lambda p: D.score_counts(D.counts(_pred(spark, list(zip(y, p, strict=True))))).first()["score"]
    assert score(y) == 1
    assert score([2] * 100) == pytest.approx(0)
    assert score([4] * 100) == pytest.approx(0)
    assert score([4 - v if v in (0, 4) else 2 for v in y]) < -1
    flat = D.score_counts(D.counts(_pred(spark, [(2, 2)] * 4))).first()["score"]
    assert flat is None


def test_first_best_factor(spark):
    x = frame(spark, [(0.0, 4), (0.0, 0)], "s double, label int")
    assert D.fit_k(x)[1].first()["k"] == 0.5
    four = D.fit_four(frame(spark, [(float(v), min(4, max(0, 2 + v))) for v in range(-3, 4)] * 5, "s double, label int"))
    assert four == sorted(four)


def test_null_signal_is_flat(spark):
    x = frame(spark, [(None,), (float(10),)], "s double")
    assert [r[0] for r in x.select(D.k_rule(F.col("s"), 1.0)).collect()] == [2, 4]


def test_cost_min(spark):
    p = frame(spark, [(0.5, 0.0, 0.0, 0.0, 0.5)], "a double, b double, c double, d double, e double")
    assert p.select(D.cost_min([F.col(c) for c in "abcde"])).first()[0] == 2


def test_holm(spark):
    got = {r["n"]: r["p_holm"] for r in E.holm(frame(spark, [("a", 0.01), ("b", 0.04), ("c", 0.03)], "n string, p double"), "n", "p").collect()}
    assert got == pytest.approx({"a": 0.03, "c": 0.06, "b": 0.06})


def test_verdicts(spark):
    good = (0.01, 0.001, 0.02, [0.01, 0.02, 0.01], 0.01, 0.0, 1.0)
    bad = (-0.01, -0.02, -0.001, [-0.01, -0.02, 0.01], 0.01, 0.0, 1.0)
    hold = (0.01, -0.001, 0.02, [0.01, 0.02, 0.01], 0.01, 0.0, 1.0)
    x = frame(spark, [good, bad, hold], "delta double, ci_low double, ci_high double, folds array<double>, unseen_delta double, flip_diff double, extreme_ratio double")
    assert [r["verdict"] for r in E.decide(x).collect()] == ["adopt", "reject", "hold"]
    assert E.decide(x).collect()[2]["reasons"] == "ci_low"


def test_text_columns(spark):
    x = frame(spark, [("Beats &amp; raises outlook - Some Wire",), (None,), ("Not a great day",)], "t string")
    r = x.select(T.clean_title(F.col("t")).alias("c"), T.is_template(F.col("t")).alias("m"), *[c.alias(n) for n, c in T.event_flags(F.col("t")).items()]).collect()
    assert r[0]["c"] == "Beats & raises outlook" and r[0]["ev_guid"] == 1 and r[1]["c"] == ""
    net, _ = T.lexicon_scores(F.col("t"), ["GREAT"], [], [])
    assert [v[0] for v in x.select(net).collect()] == [0.0, None, -0.25]
    a = T.cluster_key(F.lit("Apple profit up in May")), T.cluster_key(F.lit("up May: profit Apple"))
    assert frame(spark, [(1,)], "x int").select((a[0] == a[1])).first()[0]


def test_mentions_and_anonymity(spark):
    x = frame(spark, [("$abc and XYZ, NOW and BRK.B",)], "t string")
    assert sorted(x.select(T.mentions(F.col("t"))).first()[0]) == ["ABC", "BRK-B", "XYZ"]
    got = x.select(T.anonymize(F.lit("$AAPL rose; Apple's gain on May 3, 2024 by AAPL"), {"AAPL": ["Apple"]})).first()[0]
    assert got == "[COMPANY] rose; [COMPANY] gain on [DATE] by [COMPANY]"
    assert x.select(T.unknown_numbers(F.lit("1,200 and +3%"), F.lit("1200, 3 and 4%"))).first()[0] == ["4%"]


def test_no_look_ahead(spark, data):
    """Rows known after a cutoff change nothing of that day."""
    m = M.Market(spark, data)
    day = m.calendar.where("target is not null").agg(F.min("target")).first()[0]
    day = m.calendar.where(F.col("target") > F.lit(day)).orderBy("target").limit(8).agg(F.max("target")).first()[0]
    whole = X.build_features(m, ["event", "analyst"]).where(F.col("target") == F.lit(day))
    cut = X.day_features(m, day, ["event", "analyst"])
    diff = E.parity(whole, cut, ["gap_pct", "gap_rank", "earn", "an_n", "an_gap_agree"]).collect()
    assert all(r["null_diff"] == 0 and r["beyond"] == 0 for r in diff)


def test_empty_tables(spark, data):
    m = M.Market(spark, data)
    for name in ("daily", "price", "news", "earnings", "analyst"):
        m.__dict__[name] = getattr(m, name).limit(0)
    assert X.build_features(m, ["event", "analyst", "news"]).count() == 0


def test_groups():
    assert X.resolve(["core", "vol20", "core"]) == ["gap_pct", "gap_rank", "vol20"]
    assert X.groups_of(["vol20", "n_src_r1"]) == ["core", "scale", "txt_count"]
    with pytest.raises(ValueError):
        D.Spec("x", decision="none").check()


def test_ledger(tmp_path):
    led = E.Ledger(str(tmp_path / "l.jsonl"))
    c = {"name": "a", "decision": "k"}
    with pytest.raises(RuntimeError, match="development"):
        led.register("h", [c], {})
    with pytest.raises(RuntimeError, match="no plan"):
        led.admit("h", [c])
    led.register("h", [c], {E.spec_identity({**c, "name": "b", "seed": 4}): ["run"]})
    with pytest.raises(RuntimeError, match="not as planned"):
        led.admit("h", [{**c, "decision": "4t"}])
    with pytest.raises(RuntimeError, match="held out"):
        led.check_training("2027-01-01")
    led.check_training("2026-01-01")
    led.finish(led.admit("h", [c]), "out")
    with pytest.raises(RuntimeError, match="force"):
        E.Ledger(led.path).admit("h", [c])
    with pytest.raises(RuntimeError, match="no plan is taken"):
        led.register("h2", [c], {E.spec_identity(c): ["run"]})
    led.finish(led.admit("h", [c], force=True), "out")
    assert "again by force" in led.notes() and [e["kind"] for e in led.events()] == ["plan", "result", "result", "exposure"]
    led.check_training("2027-01-01")


def test_identity():
    """Fixed values, so that a hash made today is found tomorrow; the order of keys doesn't count, that of lists does."""
    assert E.identity({"a": 1, "b": {"c": [1, 2]}}) == E.identity({"b": {"c": [1, 2]}, "a": 1}) == "3d0662a85006"
    assert E.identity({"a": [2, 1]}) != E.identity({"a": [1, 2]})
    assert E.derive_seed(1, "model", "x", 0, "A") == 2034585135


def test_recursion():
    r = np.random.default_rng(1)
    x = r.normal(size=1000)
    want, v = [], 3.0
    for y in x:
        v = 0.1 * y + 0.9 * v
        want.append(v)
    assert S.recursion(x, 0.1, 3.0) == pytest.approx(np.array(want), abs=1e-12)


def test_sources(spark, tmp_path):
    p = tmp_path / "w.csv"
    p.write_text("Word,Negative,Positive\nloss,2009,0\ngain,0,2009\n")
    assert {(r["word"], r["kind"]) for r in M.word_lists(spark, str(p)).collect()} == {("LOSS", "negative"), ("GAIN", "positive")}
    (tmp_path / "s.json").write_text('{"a": ["X"], "b": ["Y", "X"]}')
    assert M.symbols_from(str(tmp_path / "s.json")) == ["X", "Y"] and M.symbols_from(None, "a, b") == ["A", "B"]
    (tmp_path / "n.json").write_text('{"_note": "x", "ACM": "Acme", "BLT": ["Bolt", "Bolt & Co."]}')
    assert M.names_from(str(tmp_path / "n.json")) == {"ACM": ["Acme"], "BLT": ["Bolt", "Bolt & Co."]}
    M.write(spark.range(3), str(tmp_path / "o"), "csv")
    assert spark.read.csv(str(tmp_path / "o"), header=True).count() == 3


def test_pushdown(spark, data):
    m = M.Market(spark, data)
    plan = m.raw("events").where("ts < timestamp_ntz'2024-01-10 09:30:00'").select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), LessThan(ts" in plan and "ReadSchema: struct<event_id:bigint,ts" in plan
    assert "BroadcastNestedLoopJoin" not in to_target(m.news, m.calendar)._jdf.queryExecution().executedPlan().toString()
