"""KPI marts: every result written as Parquet for a BI tool to read.

``write_kpi_marts`` writes plain folders. ``MartStore`` publishes whole refreshes: a refresh writes all its marts to a
folder of its own, and only then one small file, the pointer, is replaced in one step. Readers follow the
pointer, so they see the refresh before or the one after, never half of one; a refresh that fails leaves
everything as it was. Marts with a date can be refreshed for some days only: the pointer names a folder for each
day, and the other days' folders stay.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Marts that are written at a time: small results leave a cluster idle between their stages.
AT_A_TIME = 4


def _each(spark: SparkSession, tasks: Sequence, at_a_time: int) -> list:
    """Run functions in a few threads, each with the session's properties. The first failure is raised when
    the others have ended."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=max(1, at_a_time)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]
    return [r.result() for r in running]


def write_kpi_marts(results: Mapping[str, DataFrame], path: str, mode: str = "overwrite", at_a_time: int = AT_A_TIME) -> list[str]:
    """Write each result to ``path/<name>``; returns the written locations.

    Each write is one distributed job, and a few run at a time; the results stay lazy until written.
    """
    targets = {name: os.path.join(path, name) for name in results}
    if results:
        spark = next(iter(results.values())).sparkSession
        _each(spark, [lambda n=n, df=df: df.write.mode(mode).parquet(targets[n]) for n, df in results.items()], at_a_time)
    return list(targets.values())


def build_kpis(tables, names=None) -> dict[str, DataFrame]:
    """Every registered KPI (or the given ``names``) over ``tables``, as DataFrames. They are lazy, but
    for ``classify_entities`` and ``visitor_roster``, which write a device-sized table first, and ``ticket_outliers`` and
    ``whale_demographics``, which compute the outlier fence first."""
    from aislewise.plans.registry import OPS

    return {name: op(tables) for name, op in OPS.items() if names is None or name in names}


def read_kpi_mart(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(path, name))


class MartStore:
    """A folder of published marts. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.FileContext.getFileContext(self._uri(self.path), spark._jsc.hadoopConfiguration())

    def _uri(self, path: str):
        return self._place(path).toUri() if ":" in path else self._place(f"file:{path}").toUri()

    def _place(self, path: str):
        return self._hadoop.Path(path)

    def _pointer(self) -> dict:
        """What is published: ``version`` and, of each mart, its ``schema`` and ``folders`` (by day, or one)."""
        place = self._place(f"{self.path}/_current")
        if not self._files.util().exists(place):
            return {"version": None, "marts": {}}
        data = self._files.open(place)
        try:
            return json.loads(bytes(data.readAllBytes()).decode())
        finally:
            data.close()

    def _publish(self, pointer: dict) -> None:
        """Replace the pointer in one step: a rename over the old one."""
        flags = self.spark._jvm.java.util.EnumSet.of(self._hadoop.CreateFlag.CREATE, self._hadoop.CreateFlag.OVERWRITE)
        draft, none = self._place(f"{self.path}/_draft-{uuid.uuid4().hex}"), self.spark._sc._gateway.new_array(self._hadoop.Options.CreateOpts, 0)
        out = self._files.create(draft, flags, none)
        try:
            out.write(bytearray(json.dumps(pointer).encode()))
        finally:
            out.close()
        over = self.spark._sc._gateway.new_array(self._hadoop.Options.Rename, 1)
        over[0] = self._hadoop.Options.Rename.OVERWRITE
        self._files.rename(draft, self._place(f"{self.path}/_current"), over)

    def version(self) -> str | None:
        return self._pointer()["version"]

    def marts(self) -> list[str]:
        return sorted(self._pointer()["marts"])

    def refresh(self, results: Mapping[str, DataFrame], days: Mapping[str, str] | None = None, keep_others: bool = True, at_a_time: int = AT_A_TIME) -> str:
        """Write ``results`` and publish them together; returns the version. ``days`` names the date column of dated
        marts: of those, the days in the result replace the published ones and others stay. Marts that are not in
        ``results`` stay as they are, or go without ``keep_others``."""
        days, version = dict(days or {}), uuid.uuid4().hex
        base = f"{self.path}/versions/{version}"

        def write(name: str, df: DataFrame) -> None:
            if name in days:  # the day is kept in the rows; the folders carry a copy of it
                copy = F.coalesce(F.col(days[name]).cast("date").cast("string"), F.lit("none")).alias("mart_day")
                df.select("*", copy).write.partitionBy("mart_day").parquet(f"{base}/{name}")
            else:
                df.write.parquet(f"{base}/{name}")

        _each(self.spark, [lambda n=n, df=df: write(n, df) for n, df in results.items()], at_a_time)
        pointer = self._pointer()
        marts = dict(pointer["marts"]) if keep_others else {}
        for name, df in results.items():
            folders = {"": f"versions/{version}/{name}"}
            if name in days:
                found = self._files.util().listStatus(self._place(f"{base}/{name}"))
                new = [f.getPath().getName() for f in found if f.getPath().getName().startswith("mart_day=")]
                old = {d: f for d, f in marts.get(name, {}).get("folders", {}).items() if d}
                folders = old | {d.partition("=")[2]: f"versions/{version}/{name}/{d}" for d in new}
            marts[name] = {"schema": df.schema.json(), "folders": folders}
        self._publish({"version": version, "marts": marts})
        return version

    def read(self, name: str) -> DataFrame:
        """A mart of the published version, as it is when this is called."""
        from pyspark.sql.types import StructType

        mart = self._pointer()["marts"][name]
        schema = StructType.fromJson(json.loads(mart["schema"]))
        folders = [f"{self.path}/{f}" for f in mart["folders"].values()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def clean(self) -> int:
        """Delete the folders of versions that the pointer does not name, those of failed refreshes included;
        returns how many. Readers that began before the last refresh may still need them: call it later."""
        named = {f.split("/")[1] for mart in self._pointer()["marts"].values() for f in mart["folders"].values()}
        place, gone = self._place(f"{self.path}/versions"), 0
        if self._files.util().exists(place):
            for folder in self._files.util().listStatus(place):
                if folder.getPath().getName() not in named:
                    self._files.delete(folder.getPath(), True)
                    gone += 1
        return gone


def mart_sizes(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """``mart`` and ``n_rows`` of each written mart."""
    return _sizes({n: read_kpi_mart(spark, path, n) for n in names})


def _sizes(marts: Mapping[str, DataFrame]) -> DataFrame:
    sizes = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("mart"), "n_rows") for n, df in marts.items()]
    return reduce(DataFrame.unionByName, sizes)


def published_sizes(store: MartStore) -> DataFrame:
    """``mart`` and ``n_rows`` of each published mart."""
    return _sizes({n: store.read(n) for n in store.marts()})


def register_views(spark: SparkSession, tables, prefix: str = "kpi_") -> list[str]:
    """Register the canonical tables (geolocation, log_sales, city_population, supermarkets) and
    every KPI (``<prefix><name>``) as temporary views, for ``spark.sql`` users. Views are lazy, but those of ``classify_entities`` and ``visitor_roster``
    hold the devices, and those of ``ticket_outliers`` and ``whale_demographics`` the fence, as they were when the views were registered."""
    tables.geo.createOrReplaceTempView("geolocation")
    tables.sales.createOrReplaceTempView("log_sales")
    tables.city.createOrReplaceTempView("city_population")
    tables.branches.createOrReplaceTempView("supermarkets")
    names = []
    for name, df in build_kpis(tables).items():
        df.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names
