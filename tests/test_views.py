"""The Spark derivation of the canonical tables equals the DuckDB one."""

import pytest

from aislewise.plans.oracle_views import with_views
from aislewise.sources import schemas
from aislewise.sources.tables import derive_from_driver_tables, validate
from sf_dirs import SF_SMALL
from tools.oracle_check import duck, rows_of


@pytest.mark.parametrize("attr,name", [("geo", "geolocation"), ("sales", "log_sales"), ("city", "city_population"), ("branches", "supermarkets")])
def test_view_parity(spark, attr, name):
    df = getattr(derive_from_driver_tables(spark, SF_SMALL), attr)
    validate(df, name)
    rel = duck(SF_SMALL).execute(with_views(f"SELECT * FROM {name}"))
    cols = [c[0] for c in rel.description]
    assert cols == [f.name for f in schemas.SCHEMAS[name].fields]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, rel.fetchall())


def test_validate_rejects_wrong_type(spark):
    df = spark.createDataFrame([("1", "x")], "branch_id string, city string").selectExpr("branch_id", "1 AS city")
    with pytest.raises(TypeError):
        validate(df, "supermarkets")


def test_load_canonical_round_trip(spark, tables):
    """The production path: canonical tables stored as Parquet, read back with validation."""
    import os
    import tempfile

    from aislewise.operators.operations import staffing_gap
    from aislewise.sources.tables import load_canonical

    root = tempfile.mkdtemp(prefix="canonical-")
    paths = {}
    for name, df in (("geolocation", tables.geo), ("log_sales", tables.sales), ("city_population", tables.city), ("supermarkets", tables.branches)):
        paths[name] = os.path.join(root, name)
        df.write.parquet(paths[name])
    loaded = load_canonical(spark, paths)
    a = staffing_gap(loaded.geo, loaded.sales)
    b = staffing_gap(tables.geo, tables.sales)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0
