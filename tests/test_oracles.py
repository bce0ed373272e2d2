"""Every query of the catalogue against its SQL on the smallest data."""

import pytest

from foreopen.plans import catalog
from tests.conftest import same

Q, O = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(O))
def test_equals_sql(spark, data, duck, name):
    same(Q[name](spark, data), duck, O[name])


@pytest.mark.parametrize("name", ["text_vectors", "anonymize_titles", "explain_rows", "regime_text"])
def test_runs(spark, data, name):
    assert Q[name](spark, data).count() > 0


def test_text_vectors_count_the_terms(spark):
    """Rows, terms and lengths of every vectorizer, where the plan once failed; terms as the SQL of vector_terms has them."""
    data = "/root/testdata/sf0.01"
    got = Q["text_vectors"](spark, data).collect()
    terms = {(r["doc_id"], r["kind"]): r["terms"] for r in Q["vector_terms"](spark, data).collect()}
    kinds = {r["kind"] for r in got}
    assert len(kinds) == 8 and len(got) == len({(r["doc_id"], r["kind"]) for r in got}) == 8 * spark.read.parquet(f"{data}/documents.parquet").count()
    assert {(r["doc_id"], r["kind"]): r["terms"] for r in got if (r["doc_id"], r["kind"]) in terms} == terms
    assert all(r["norm"] == pytest.approx(1.0 if r["terms"] else 0.0) for r in got if r["kind"] not in ("count_uni", "lm_vocab"))


@pytest.mark.parametrize("name", ["parity_all", "parity_text"])
def test_day_path_is_the_batch_path(spark, data, name):
    """Every column of days made by themselves: no null and no value differs."""
    got = Q[name](spark, data).collect()
    assert len(got) > 20 and all(r["n"] > 0 and r["null_diff"] == 0 and r["beyond"] == 0 for r in got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
