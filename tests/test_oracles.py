"""Every registered query with an SQL twin gives the rows DuckDB gives."""

import pytest
from check import difference

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, spark, duck, sf):
    got = entry.queries()[name](spark, sf).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert difference(got, want) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.columns == ["id", "pred_model", "score"]
    assert out.count() == 40
