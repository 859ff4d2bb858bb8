"""Every query of the library against its SQL twin, or at least its rows."""

import pytest
from support import DATA, same_rows

from cohortlake.plans import REGISTRY


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql])
def test_sql(spark, duck, name):
    q = REGISTRY[name]
    same_rows(q.build(spark, DATA), duck, q.sql)


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if not q.sql and n not in ("run_experiments", "cross_validate")])
def test_rows(spark, name):
    assert REGISTRY[name].build(spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 81
    assert set(e.oracle_sql()) <= set(e.queries())
