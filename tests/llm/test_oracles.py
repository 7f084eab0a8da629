"""The text queries that SQL can say, against DuckDB."""

import pytest

from aislewise.llm.registry import ORACLES, QUERIES
from tools.oracle_check import duck, rows_of


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    base = "/root/testdata/sf0.001"
    df = QUERIES[name](spark, base)
    rows = [tuple(r) for r in df.collect()]
    rel = duck(base).execute(ORACLES[name])
    cols = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, rows) == rows_of(cols, rel.fetchall())


def test_chosen_by_hash(spark):
    """As many rows of each key as wanted or there are, the same whatever the partitions."""
    from aislewise.llm.common import chosen_by_hash

    rows = spark.range(20_000).selectExpr("id", "case when id % 1000 = 0 then 'rare' when id % 3 = 0 then 'some' else 'many' end AS k")
    a = chosen_by_hash(rows.repartition(3), "k", 50)
    assert {r["k"]: r["count"] for r in a.groupBy("k").count().collect()} == {"rare": 20, "some": 50, "many": 50}
    assert a.exceptAll(chosen_by_hash(rows.repartition(17), "k", 50)).count() == 0
