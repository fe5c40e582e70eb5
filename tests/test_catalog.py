import pytest

from seamline.plans import catalog, catalog_more  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(name, spark, sf, same_rows):
    same_rows(catalog.QUERIES[name](spark, sf), catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(name, spark, sf):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry_imports_without_the_other_operators(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(catalog.QUERIES) <= set(q) and set(o) <= set(q)
    assert e.entry(spark).count() == 1


def test_nothing_else_imports_them():
    import pathlib

    root = pathlib.Path(catalog.__file__).parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "seamline.llm" not in p.read_text() and "from seamline import llm" not in p.read_text()


def test_linear_detector_has_the_whole_model(spark, sf, monkeypatch):
    from seamline.operators.models import LinearDetector

    seen, fit = [], LinearDetector.fit
    monkeypatch.setattr(LinearDetector, "fit", lambda self, docs: seen.append(self) or fit(self, docs))
    catalog.QUERIES["linear_detector"](spark, sf)
    assert [(m.ngram, m.max_features, m.max_iter) for m in seen] == [((2, 4), 200_000, 2000)] and seen[0].model.summary.totalIterations > 20
