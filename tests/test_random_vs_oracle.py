"""Every operator against its oracle SQL on seeded random canonical tables.

The generator favours the cases that break rewrites: NULL roles, areas, accuracies and
customers, equal timestamps, gaps at exactly the session thresholds, devices that are also
customers, city names with blanks, and money with two decimals.
"""

import datetime as dt
import random

import duckdb
import pyarrow as pa
import pytest

from aislewise.plans.oracles import over_canonical_tables
from aislewise.plans.registry import OPS, STORE_CITY
from aislewise.sources import schemas
from aislewise.sources.tables import RetailTables
from tools.oracle_check import rows_of

ROLES = ["manager", "cashier", "butcher", "general_worker", "senior_general_worker", "security_guy", "delivery_guy",
         "repeat_customer", "one_time_customer", "not_paying", "customer", None]
AREAS = ["WAREHOUSE", "HEAD_OFFICE", "CASH_REGISTERS", "BUTCHERY", "PARKING", "SUPERMARKET", None]
METHODS = ["physical_card", "cash", "mobile", "voucher", None]


def generate(seed):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1, 6, 0)
    devices = [f"d{i}" for i in range(14)]
    geo = []
    for dev in devices + [None]:
        role = rnd.choice(ROLES)
        t = base + dt.timedelta(days=rnd.randint(0, 10), minutes=rnd.randint(0, 600))
        for _ in range(rnd.randint(1, 40)):
            step = rnd.choice([0, 1, 19, 20, 21, 60, 61, 200, 60 * 24 * rnd.randint(1, 9)])
            t += dt.timedelta(minutes=step, seconds=rnd.choice([0, 0, 59]), microseconds=rnd.choice([0, 999999]))
            if rnd.random() < 0.05:
                role = rnd.choice(ROLES)  # a device seen under two roles
            geo.append((dev, None if rnd.random() < 0.02 else t, rnd.choice(AREAS), rnd.choice([None, 30.0, 12.5, 45.0, rnd.uniform(0, 80)]), role))
    sales = []
    customers = devices[:9] + ["x1", "x2", None, None]
    for i in range(160):
        cust = rnd.choice(customers)
        t = base + dt.timedelta(days=rnd.randint(0, 60), hours=rnd.randint(0, 14), minutes=rnd.choice([0, 30, 60, 61, 121]))
        total = round(rnd.choice([rnd.uniform(1, 400), rnd.uniform(300, 1500), 300.0, 800.0, 1139.0, 0.0, -5.0, 9000.0]), rnd.choice([2, 2, 3, 5]))
        t = None if rnd.random() < 0.03 else t
        dwell = None if cust is None else rnd.choice([None, 0, 1, 2, 5, 119, 120, 121, 179, 180, rnd.randint(1, 200)])
        sales.append((f"S{i:04d}", cust, t, total, rnd.choice(METHODS), dwell))
    cities = [(f" {STORE_CITY} ", 60156), (" A ", 20000), ("B", 0), ("C ", 9000), (" D", 10001), ("\tT\u00a0", 20001)]
    branches = [("1", STORE_CITY), ("2", f"{STORE_CITY} "), ("3", "A"), ("4", "A "), ("5", " D"), ("6", "E"), ("7", "T ")]
    return {"geolocation": geo, "log_sales": sales, "city_population": cities, "supermarkets": branches}


ARROW = {"string": pa.string(), "timestamp_ntz": pa.timestamp("us"), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64()}


def arrow(name, rows):
    fields = schemas.SCHEMAS[name].fields
    return pa.table({f.name: pa.array([r[i] for r in rows], type=ARROW[f.dataType.simpleString()]) for i, f in enumerate(fields)})


@pytest.fixture(scope="module", params=[11, 23, 37])
def world(request, spark):
    data = generate(request.param)
    con = duckdb.connect()
    for name, rows in data.items():
        con.register(name, arrow(name, rows))
    df = {name: spark.createDataFrame(rows, schemas.SCHEMAS[name]) for name, rows in data.items()}
    tables = RetailTables(df["geolocation"], df["log_sales"], df["city_population"], df["supermarkets"])
    return tables, con


@pytest.mark.parametrize("name", sorted(OPS))
def test_random_tables_match_oracle(world, name):
    tables, con = world
    df = OPS[name](tables)
    rows = [tuple(r) for r in df.collect()]
    rel = con.execute(over_canonical_tables(name))
    cols = [c[0] for c in rel.description]
    expected = rel.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, rows) == rows_of(cols, expected)
