"""Fact tables bucketed by who they are about: pings by device, tickets by customer.

Sessions, profiles and rosters group and join by device or customer. On tables whose files are already dealt by
that column Spark plans them without a shuffle, in every query: the one shuffle is paid when the table is written.

A bucket is read by one task. That suits tables whose devices are of similar size; a device with a large part of all
rows would make its bucket the longest task of every query, and AQE does not split bucketed scans. So writing counts the
buckets' rows and refuses such a table (``max_skew``); the operators spread a hot device over map tasks on plain files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewise.sources.tables import RetailTables


class SkewedBuckets(ValueError):
    """One bucket holds too much of a table."""


def skew(df: DataFrame, column: str, buckets: int) -> float:
    """Rows of the largest bucket over the mean, as the table would be dealt."""
    counts = df.groupBy(F.pmod(F.hash(column), F.lit(buckets)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    most, rows = counts.agg(F.max("n"), F.sum("n")).first()
    return most * buckets / rows if rows else 0.0


def write_bucketed(tables: RetailTables, prefix: str = "", buckets: int = 200, max_skew: float = 4.0) -> dict[str, str]:
    """Save ``geolocation`` (by device) and ``log_sales`` (by customer) as bucketed tables of the session's catalog,
    ``prefix`` before their names; returns those names. Tickets without a customer stand in a table of their own,
    dealt by nothing, so that they are no bucket: ``<prefix>log_sales_anonymous``."""
    parts = {"geolocation": (tables.geo, "device_id"), "log_sales": (tables.sales.where("customer_id IS NOT NULL"), "customer_id")}
    names = {}
    for table, (df, column) in parts.items():
        worst = skew(df, column, buckets)
        if worst > max_skew:
            raise SkewedBuckets(f"{table}: the largest of {buckets} buckets by {column} has {worst:.1f} times the mean; use plain files")
    for table, (df, column) in parts.items():
        names[table] = f"{prefix}{table}"
        df.repartition(buckets, column).write.bucketBy(buckets, column).mode("overwrite").saveAsTable(names[table])
    names["log_sales_anonymous"] = f"{prefix}log_sales_anonymous"
    tables.sales.where("customer_id IS NULL").write.mode("overwrite").saveAsTable(names["log_sales_anonymous"])
    return names


class BucketedTables:
    """The canonical tables with pings and tickets from bucketed tables; ``sales`` has all tickets."""

    def __init__(self, spark: SparkSession, names: dict[str, str], others: RetailTables):
        self.spark, self.names = spark, names
        self.city, self.branches = others.city, others.branches

    @property
    def geo(self) -> DataFrame:
        return self.spark.table(self.names["geolocation"])

    @property
    def sales(self) -> DataFrame:
        return self.identified.unionByName(self.spark.table(self.names["log_sales_anonymous"]))

    @property
    def identified(self) -> DataFrame:
        """Tickets with a customer, in buckets by customer."""
        return self.spark.table(self.names["log_sales"])
