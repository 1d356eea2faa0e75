"""Every query with SQL gives the rows of its SQL."""

import pytest

from foliolake.plans import catalog
from same import same_rows


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, sf, duck, name):
    same_rows(catalog.QUERIES[name](spark, sf), duck, catalog.SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_figures_stay_on_a_page(spark, sf):
    rows = catalog.QUERIES["c15_place_figures"](spark, sf).collect()
    assert rows
    assert all(r.line_pos % 15 + 6 <= 15 for r in rows if r.figure)
