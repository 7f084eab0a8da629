"""Loading the four canonical tables.

``load_canonical`` reads real data (Parquet, one folder or file per table) and
checks names and types against ``schemas``. ``derive_from_driver_tables`` builds
the same four tables from the TPC-H-like test tables (events, orders, nation,
supplier); the rules are listed in FIXTURES.md section C. Both are lazy: the
derivation is a narrow projection of each source scan, so filters and column
pruning still reach the Parquet readers.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from aislewise.sources import schemas


class RetailTables:
    """The four canonical tables: ``geo``, ``sales``, ``city`` and ``branches``."""

    def __init__(self, geo: DataFrame, sales: DataFrame, city: DataFrame, branches: DataFrame):
        self.geo = geo
        self.sales = sales
        self.city = city
        self.branches = branches


def validate(df: DataFrame, name: str) -> DataFrame:
    """Check that ``df`` has every canonical column with the canonical type; keep only those."""
    expected = schemas.SCHEMAS[name]
    have = {f.name: f.dataType for f in df.schema.fields}
    for field in expected.fields:
        if field.name not in have:
            raise ValueError(f"{name}: missing column {field.name}")
        if have[field.name] != field.dataType:
            raise TypeError(f"{name}.{field.name}: expected {field.dataType.simpleString()}, got {have[field.name].simpleString()}")
    return df.select(*[f.name for f in expected.fields])


def load_canonical(spark: SparkSession, paths: dict[str, str]) -> RetailTables:
    """Read the canonical tables from Parquet. ``paths`` maps table name to location."""
    def read(name: str) -> DataFrame:
        return validate(spark.read.parquet(paths[name]), name)

    return RetailTables(
        geo=read("geolocation"),
        sales=read("log_sales"),
        city=read("city_population"),
        branches=read("supermarkets"),
    )


# ---------------------------------------------------------------------------
# Derivation from the driver's test tables (FIXTURES.md section C).
# ---------------------------------------------------------------------------

# Fixed values of the fixture derivation.
_STAFF_ROLE_BY_INDEX = ("cashier", "delivery_guy", "security_guy", "butcher", "manager", "general_worker", "senior_general_worker")
_VISITOR_ROLE_BY_INDEX = ("one_time_customer", "repeat_customer", "not_paying")
_PAYMENT_BY_PRIORITY = {
    "1-URGENT": "physical_card",
    "2-HIGH": "physical_card",
    "3-MEDIUM": "cash",
    "4-NOT SPECIFIED": "mobile",
    "5-LOW": "voucher",
}
_STAFF_HOME_AREA = {
    "cashier": "CASH_REGISTERS",
    "delivery_guy": "WAREHOUSE",
    "security_guy": "PARKING",
    "butcher": "BUTCHERY",
    "manager": "HEAD_OFFICE",
}


def _case(subject: str, mapping, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {k!r} THEN {v!r}" if isinstance(k, str) else f"WHEN {k} THEN {v!r}" for k, v in mapping)
    return f"CASE {subject} {whens} ELSE {default} END"


# The derivation is written as SQL expressions: one ``selectExpr`` per table builds the whole
# projection in a single call, and Catalyst sees the same plan as with Column objects.
_SOD = "CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT)"
_VISIT_SOD = f"(28800 + (user_id % 10) * 3600 + CAST(floor({_SOD} / 12) AS BIGINT))"
_STAFF_ROLE = _case("CAST(floor(user_id / 5) AS BIGINT) % 7", enumerate(_STAFF_ROLE_BY_INDEX))
_STRETCHED_DAY = "date_add(DATE'2024-01-01', 3 * datediff(to_date(ts), DATE'2024-01-01'))"

GEOLOCATION_EXPRS = (
    "CAST(user_id AS STRING) AS device_id",
    f"""CASE WHEN user_id % 5 = 0 THEN timestampadd(SECOND, {_SOD}, CAST(to_date(ts) AS TIMESTAMP_NTZ))
             WHEN user_id % 3 = 0 THEN timestampadd(SECOND, {_VISIT_SOD}, CAST(to_date(ts) AS TIMESTAMP_NTZ))
             ELSE timestampadd(SECOND, {_VISIT_SOD}, CAST({_STRETCHED_DAY} AS TIMESTAMP_NTZ)) END AS timestamp""",
    f"""CASE WHEN user_id % 5 = 0 AND event_id % 5 <> 0
               THEN {_case(_STAFF_ROLE, _STAFF_HOME_AREA.items(), "'SUPERMARKET'")}
             WHEN event_id % 10 <= 3 THEN 'SUPERMARKET'
             WHEN event_id % 10 <= 7 THEN 'CASH_REGISTERS'
             WHEN event_id % 10 = 8 THEN 'PARKING'
             ELSE 'BUTCHERY' END AS area""",
    "CAST(value AS DOUBLE) AS accuracy_m",
    f"""CASE WHEN user_id % 5 = 0 THEN {_STAFF_ROLE}
             WHEN user_id % 50 = 49 THEN CAST(NULL AS STRING)
             ELSE {_case("user_id % 3", enumerate(_VISITOR_ROLE_BY_INDEX))} END AS role""",
)

_TOT = "(floor(o_totalprice * (o_custkey % 5 + 1) * (CASE WHEN o_orderkey % 29 = 0 THEN 5 ELSE 1 END) / 12) / 100)"
LOG_SALES_EXPRS = (
    "concat('S', CAST(o_orderkey AS STRING)) AS sale_id",
    "CASE WHEN o_custkey % 3 = 2 THEN CAST(NULL AS STRING) ELSE CAST(o_custkey AS STRING) END AS customer_id",
    "timestampadd(SECOND, 28800 + (o_orderkey * 7919) % 50400, CAST(o_orderdate AS TIMESTAMP_NTZ)) AS timestamp",
    f"CAST({_TOT} AS DOUBLE) AS total",
    f"{_case('o_orderpriority', _PAYMENT_BY_PRIORITY.items())} AS payment_method",
    f"CASE WHEN o_custkey % 3 = 2 THEN CAST(NULL AS INT) ELSE CAST(floor({_TOT} / 10) + o_orderkey % 17 AS INT) END AS dwell_minutes",
)


def geolocation_from_events(events: DataFrame) -> DataFrame:
    return events.selectExpr(*GEOLOCATION_EXPRS)


def log_sales_from_orders(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(*LOG_SALES_EXPRS)


def city_population_from_nation(nation: DataFrame) -> DataFrame:
    return nation.selectExpr(
        "concat(' ', n_name, ' ') AS city_name", "CAST(n_nationkey * 1500 AS BIGINT) AS total_population"
    )


def supermarkets_from_supplier(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    # nation is a fixed 25-row dimension; Catalyst broadcasts it by its file size.
    joined = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
    return joined.selectExpr(
        "CAST(s_suppkey AS STRING) AS branch_id",
        "CASE WHEN s_suppkey % 2 = 0 THEN concat(n_name, ' ') ELSE n_name END AS city",
    )


class DriverTables(RetailTables):
    """The four canonical tables over the driver's files, each built on first use.

    By default every use derives the rows from the files as they are at that time; the derivation
    is a projection of the scan. With ``materialize``, each canonical table is written once as
    Parquet under the checkpoint folder (deleted with the session) and read from there, so that
    filters on canonical columns (role, area, customer) reach the Parquet reader. That is a copy of
    the facts: worth it for many queries in one session, and never done unasked.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, materialize: bool = False):
        self._spark = spark
        self._dir = sf_dir
        self._materialize = materialize
        self._built: dict[str, DataFrame] = {}

    def _read(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._spark.read.parquet(os.path.join(self._dir, f"{name}.parquet"))
        return self._built[name]

    def _once(self, key: str, canonical: str, make) -> DataFrame:
        if key not in self._built:
            df = make()
            if self._materialize:
                df = self._write_canonical(canonical, df)
            self._built[key] = df
        return self._built[key]

    def _write_canonical(self, canonical: str, df: DataFrame) -> DataFrame:
        from aislewise.session import materialize

        return validate(materialize(df), canonical)

    @property
    def geo(self) -> DataFrame:
        return self._once("geo", "geolocation", lambda: geolocation_from_events(self._read("events")))

    @property
    def sales(self) -> DataFrame:
        return self._once("sales", "log_sales", lambda: log_sales_from_orders(self._read("orders")))

    @property
    def city(self) -> DataFrame:
        return self._once("city", "city_population", lambda: city_population_from_nation(self._read("nation")))

    @property
    def branches(self) -> DataFrame:
        return self._once(
            "branches", "supermarkets", lambda: supermarkets_from_supplier(self._read("supplier"), self._read("nation"))
        )


def derive_from_driver_tables(spark: SparkSession, sf_dir: str, materialize: bool = False) -> RetailTables:
    """Canonical tables over the driver's files, built when first used (see ``DriverTables``)."""
    return DriverTables(spark, sf_dir, materialize=materialize)
