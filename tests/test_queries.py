"""Every registered query of the library against its SQL, row by row."""

import pytest
from conftest import SF, same

from tesserae.plans.oracles import ORACLES
from tesserae.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    same(QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df())


def test_all_but_frechet_distances_have_sql():
    assert set(QUERIES) - set(ORACLES) == {"frechet", "eval_report"}


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert e.entry(spark).count() == 9
