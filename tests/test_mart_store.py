"""Versioned publication of marts: readers never see half a refresh."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from aislewise.sources.marts import MartStore, published_sizes


@pytest.fixture()
def store(spark, tmp_path):
    return MartStore(spark, str(tmp_path / "marts"))


def small(spark, n, value="x"):
    return spark.range(n).withColumn("value", F.lit(value))


def broken(spark):
    """Fails when it is written, not when it is planned."""
    return spark.range(10).withColumn("value", F.expr("raise_error('no such shop')").cast("string"))


def test_nothing_published(store):
    assert store.version() is None and store.marts() == [] and store.clean() == 0
    with pytest.raises(KeyError):
        store.read("a")


def test_refresh_and_failure_between_two_marts(spark, store):
    first = store.refresh({"a": small(spark, 3), "b": small(spark, 4)})
    held = store.read("b")  # a reader that began before
    assert store.version() == first and store.marts() == ["a", "b"]
    with pytest.raises(PySparkException):
        store.refresh({"a": small(spark, 30, "new"), "b": broken(spark), "c": small(spark, 1)}, at_a_time=1)
    assert store.version() == first and store.marts() == ["a", "b"]
    assert (store.read("a").count(), store.read("b").count()) == (3, 4)
    second = store.refresh({"a": small(spark, 30, "new")})
    assert second != first and (store.read("a").count(), store.read("b").count(), held.count()) == (30, 4, 4)
    assert {r["mart"]: r["n_rows"] for r in published_sizes(store).collect()} == {"a": 30, "b": 4}
    assert store.clean() == 1  # the failed one; the first still holds b
    store.refresh({"a": small(spark, 5)}, keep_others=False)
    assert store.marts() == ["a"] and store.clean() == 2 and store.read("a").count() == 5


def test_a_crash_before_the_pointer(spark, store, monkeypatch):
    """Everything is written, then the driver is lost: readers keep the old version, the next refresh works."""
    store.refresh({"a": small(spark, 3)})

    def lost(pointer):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(store, "_publish", lost)
    with pytest.raises(RuntimeError):
        store.refresh({"a": small(spark, 9)})
    monkeypatch.undo()
    assert store.read("a").count() == 3
    store.refresh({"a": small(spark, 4)})
    assert store.read("a").count() == 4


def test_dated_marts(spark, store):
    day = lambda a, b, v: spark.range(a, b).selectExpr("if(id = 7, NULL, date_add(date'2024-01-01', cast(id as int))) AS day", f"'{v}' AS v", "id")
    store.refresh({"d": day(0, 8, "old"), "other": small(spark, 2)}, days={"d": "day"})
    version = store.refresh({"d": day(5, 10, "new")}, days={"d": "day"})
    got = {r["id"]: (r["v"], str(r["day"])) for r in store.read("d").collect()}
    assert len(got) == store.read("d").count() == 10 and store.read("d").columns == ["day", "v", "id"]
    assert all(got[i][0] == ("old" if i < 5 else "new") for i in range(10))
    assert got[7][1] == "None" and got[9][1] == "2024-01-10" and store.read("other").count() == 2
    assert store.version() == version
    store.refresh({"d": day(0, 0, "none")}, days={"d": "day"})  # no days: nothing changes
    assert store.read("d").count() == 10 and store.clean() == 1  # the empty one
    store.refresh({"d": day(0, 2, "whole")})  # not dated any more: replaced as a whole
    assert store.read("d").count() == 2


def test_an_empty_mart_keeps_its_schema(spark, store):
    store.refresh({"e": small(spark, 0)})
    assert store.read("e").columns == ["id", "value"] and store.read("e").count() == 0
