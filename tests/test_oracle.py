"""Every registered query of the library against its SQL, and the others for their rows."""

import pytest
from conftest import SF, same_rows

from rastrum.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    same_rows(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"lbg_train"}))
def test_query_without_sql_runs(spark, name):
    QUERIES[name](spark, SF).count()


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    row = entry.entry(spark).collect()[0]
    assert row["message_ok"] and row["restored_ok"] and row["bits_embedded"] == 112
