"""Every registered query of the engine itself against its SQL twin."""

import pytest

from vectrine.plans import catalog, sources  # noqa: F401  (sources registers its queries)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(name, spark, sf, duck, same_rows):
    same_rows(catalog.queries()[name](spark, sf), catalog.oracle_sql()[name], duck)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(name, spark, sf):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["qid", "id", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
