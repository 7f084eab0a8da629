"""Every registered query of the library against its DuckDB oracle (the driver's correctness gate).
The text queries have their own tests."""

import pytest

import __spark_entry__ as entry
from aislewise.plans.registry import QUERIES
from sf_dirs import SF_CHECK, SF_SMALL
from tools.oracle_check import duck, rows_of

NAMES = sorted(QUERIES)


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(entry.queries()) and set(NAMES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("sf", [SF_SMALL, SF_CHECK])
@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, name, sf):
    df = entry.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    rel = duck(sf).execute(entry.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    expected = rel.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert len(rows) == len(expected)
    assert rows_of(df.columns, rows) == rows_of(cols, expected)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["final_user_id", "final_calculated_role"]
    assert df.count() > 0
