"""Configuration, runs, splits, samples, export and the command line."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from foreopen.plans import runs as R
from foreopen.sources.market import Market

CONFIG = """
name = "tiny"
seed = 3
[data]
groups = ["core", "scale", "regime"]
[split]
embargo_days = 2
n_draws = 1
n_seen = 4
n_unseen = 5
universe_size = 8
[[split.folds]]
name = "A"
start = "2024-01-18"
end = "2024-01-30"
[eval]
baseline = "k"
bootstrap = 20
[[candidates]]
name = "k"
signal = { type = "gap" }
decision = { type = "k" }
[[candidates]]
name = "flat"
decision = { type = "flat" }
"""


@pytest.fixture(scope="module")
def market(spark):
    return Market(spark, "/root/testdata/sf0.01")


def test_run(spark, market, tmp_path):
    (tmp_path / "c.toml").write_text(CONFIG)
    cfg = R.load_config(str(tmp_path / "c.toml"))
    out = R.run(market, cfg, str(tmp_path))
    assert out["predictions"].groupBy("candidate").count().count() == 2
    row = out["compare"].first()
    assert row["candidate"] == "flat" and row["verdict"] in ("adopt", "hold", "reject") and row["delta"] < 0
    assert "verdict" in (tmp_path / f"tiny_{cfg['hash']}" / "report.md").read_text()


@pytest.mark.parametrize("bad", [{"x": 1}, {"candidates": [{"name": "a"}, {"name": "a"}]}, {"eval": {"baseline": "z"}}, {"split": {"folds": [{"name": "A", "start": "2026-01-01", "end": "2026-07-01"}]}}, {"split": {"lockbox_start": "2030-01-01"}}])
def test_bad_config(bad):
    with pytest.raises(ValueError):
        R.check_config(bad)


def test_config_resolves():
    """Defaults, whole lists, the hash of what is resolved, and every fault named at once."""
    a = R.check_config({"name": "x", "eval": {"bootstrap": 20}})
    assert a["split"]["embargo_days"] == 14 and a["eval"] == {"baseline": None, "bootstrap": 20, "block_days": 5} and a["adopt"]["alpha"] == 0.05
    assert R.check_config({"eval": {"bootstrap": 20}, "name": "x", "seed": 1})["hash"] == a["hash"] != R.check_config({"name": "x"})["hash"]
    with pytest.raises(ValueError, match="x is no setting.*baseline z"):
        R.check_config({"x": 1, "eval": {"baseline": "z"}})
    with pytest.raises(ValueError, match="split.n_draws"):
        R.check_config({"split": {"n_draws": "three"}})
    with pytest.raises(ValueError, match="research"):
        R.check_config({"data": {"research": ["moon"]}})
    assert R.check_config({"analysis": {"anything": 1}})["analysis"] == {"anything": 1}


def test_run_with_research_and_text(spark, market, tmp_path):
    """Research columns and text groups reach the candidates."""
    from foreopen.plans.text_queries import aliases

    cfg = R.check_config({
        "data": {"groups": ["core", "scale", "txt_count", "txt_text"], "research": ["reddit", "llm_anon"]},
        "split": {"n_draws": 1, "n_seen": 4, "n_unseen": 5, "universe_size": 20, "embargo_days": 2, "folds": [{"name": "A", "start": "2024-01-18", "end": "2024-01-30"}]},
        "candidates": [{"name": "m", "signal": {"type": "column", "features": ["mentions_abn"]}, "decision": "k"}, {"name": "t", "decision": "k", "regime": {"type": "textclf", "params": {"vectorizer": "count_uni", "min_df": 2}}}],
    })
    llm = spark.createDataFrame([("TAA", dt.date(2024, 1, 19), 1.0, 2.0, 3.0)], "symbol string, target date, sign double, severity double, unexpected double")
    draws = R.E.universe_draws(market.daily, 1, 5, 4, 20, 1)
    panel = R.universe_panels(market, draws, cfg["data"]["groups"], cfg["data"]["research"], aliases(market), llm={"llm_anon": llm})
    assert {"mentions_abn", "llm_anon_sign", "titles_r1", "n_clu_r1"} <= set(panel.columns) and panel.where("mentions_abn is not null").count() > 0
    out = R.run(market, cfg, aliases=aliases(market), llm={"llm_anon": llm})
    assert {r["candidate"] for r in out["predictions"].select("candidate").distinct().collect()} == {"m", "t"}
    with pytest.raises(ValueError, match="aliases"):
        R.universe_panels(market, draws, ["txt_count"])


def test_panel_is_kept(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for key in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert R.kept_panel(spark, str(tmp_path), key, make).count() == 3
    assert len(made) == 2


def test_day_timings(market):
    got = R.day_timings(market, [dt.date(2024, 1, 18)], {"price": ["core"], "events": ["core", "event"]})
    assert [(n, d) for n, d, _ in got] == [("price", "2024-01-18"), ("events", "2024-01-18")] and all(x > 0 for *_, x in got)


def test_missing_and_extra_predictions_show(market):
    from foreopen.operators import experiments as E

    got = R.predict(market, None)
    days = R.X.grid(market.daily, market.calendar)
    assert E.validate(got, days).count() == 0
    assert {r["problem"] for r in E.validate(got.where("symbol <> 'TAA'"), days).collect()} == {"missing"}
    assert {r["problem"] for r in E.validate(got, days.where("symbol <> 'TAA'")).collect()} == {"extra"}


def test_splits(spark):
    days = [(s, dt.date(2024, 1, d)) for s in "ABCDEF" for d in range(1, 29)]
    p = spark.createDataFrame(days, "symbol string, target date")
    wf = R.splits(p, "walk_forward", starts=["2024-01-15"], horizon_days=5, embargo_days=3).groupBy("part").agg(F.min("target").alias("a"), F.max("target").alias("b"))
    got = {r["part"]: (r["a"].day, r["b"].day) for r in wf.collect()}
    assert got == {"train": (1, 11), "test": (15, 19)}
    hold = R.splits(p, "symbol_holdout", n_sets=2, k=2)
    assert {r["n"] for r in hold.where("part = 'test'").groupBy("split").agg(F.count_distinct("symbol").alias("n")).collect()} == {2}
    both = R.splits(p, "time_symbol_holdout", n_sets=2, k=2, start="2024-01-20", embargo_days=2)
    assert both.where("part = 'train'").agg(F.max("target")).first()[0] == dt.date(2024, 1, 17)


def test_representative(spark):
    rows = [("S", dt.date(2024, 1, 1), f"t{'x' * i}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i % 5) for i in range(40)]
    pool = spark.createDataFrame(rows, "symbol string, target date, text string, created_et timestamp, ticker_mentions int")
    got = R.representative(pool, 12).collect()
    assert len(got) == 12 and len({r["text"] for r in got}) == 12 and {"random", "long"} <= {r["sample_type"] for r in got}


def test_predict_and_evaluate(market):
    got = R.predict(market, None, "2024-01-16")
    assert got.count() == market.daily.select("symbol").distinct().count() and got.where("label not between 0 and 4").count() == 0
    assert R.evaluate(market, None, "2024-01-16").agg(F.min("target")).first()[0] >= dt.date(2024, 1, 16)


def test_export(market, tmp_path):
    cfg = R.check_config({"candidates": [{"name": "t", "signal": {"type": "regress", "features": ["core"], "params": {"trees": 2}}}], "data": {"groups": ["core"]}})
    R.export(market, cfg, "t", "2024-01-25", str(tmp_path / "m"))
    again = R.load_export(str(tmp_path / "m"))
    assert R.predict(market, again, "2024-01-16").count() > 0


def test_delta_table(spark, market):
    from foreopen.operators import features as X

    panel = X.with_labels(X.build_features(market, ["scale"]), market.daily)
    parts = R.splits(panel, "walk_forward", starts=["2024-01-20"], embargo_days=1)
    got = R.delta_table(panel, ["gap_pct"], {"scale": ["vol5"]}, parts).collect()
    assert [r["group"] for r in got] == ["base", "scale"]
