"""Hand-made canonical tables that reach the boundary cases the test tables miss.

The same rows are loaded into Spark and into DuckDB (as Arrow tables), so every
operator can be compared with its oracle SQL on them.
"""

from __future__ import annotations

import datetime as dt

import pyarrow as pa

from aislewise.sources import schemas

D = dt.datetime
M = dt.timedelta(minutes=1)
S = dt.timedelta(seconds=1)


def geolocation_rows():
    rows = []

    def ping(dev, ts, area="SUPERMARKET", acc=10.0, role="repeat_customer"):
        rows.append((dev, ts, area, acc, role))

    # Session gaps of exactly 60:00, 60:59.999999 and 61:00, two equal timestamps, and the same
    # around 20 minutes at the registers; crosses midnight and an hour edge.
    t = D(2024, 3, 4, 23, 20)  # Monday
    for step in (0 * M, 60 * M, 60 * M + 59 * S + dt.timedelta(microseconds=999999), 61 * M, 0 * M, 5 * M):
        t = t + step
        ping("gapdev", t, "CASH_REGISTERS", 12.0, "one_time_customer")
    t = D(2024, 3, 7, 14, 0)  # Thursday
    for step in (0 * M, 20 * M, 20 * M + 59 * S, 21 * M, 3 * M, 0 * M, 1 * M):
        t = t + step
        ping("gapdev", t, "CASH_REGISTERS", 31.0, "one_time_customer")
    # A device seen on one day only, and one with NULL role / area / accuracy.
    ping("oneday", D(2024, 3, 5, 10, 0), "BUTCHERY", 30.0, "one_time_customer")
    ping("oneday", D(2024, 3, 5, 10, 45), "BUTCHERY", 30.0001, "one_time_customer")
    ping("norole", D(2024, 3, 6, 11, 0), None, None, None)
    ping("norole", D(2024, 3, 6, 12, 30), "PARKING", 45.0, None)
    # A device listed under two roles.
    ping("tworole", D(2024, 3, 8, 9, 0), "CASH_REGISTERS", 5.0, "repeat_customer")
    ping("tworole", D(2024, 3, 8, 9, 30), "CASH_REGISTERS", 55.0, "cashier")
    # A repeat customer: 11 visits a week apart (tenure 70 days, mean gap 7).
    for k in range(11):
        ping("loyal", D(2024, 1, 2, 17, 0) + k * dt.timedelta(days=7), "SUPERMARKET", 8.0, "repeat_customer")
        ping("loyal", D(2024, 1, 2, 17, 40) + k * dt.timedelta(days=7), "CASH_REGISTERS", 40.0, "repeat_customer")
    # Same pattern but never pays -> not_paying; and a near-repeat with only 9 visits.
    for k in range(11):
        ping("browser", D(2024, 1, 3, 12, 0) + k * dt.timedelta(days=7), "SUPERMARKET", 8.0, "not_paying")
    for k in range(9):
        ping("almost", D(2024, 1, 3, 12, 0) + k * dt.timedelta(days=8), "SUPERMARKET", 8.0, "repeat_customer")
    # Staff: exactly three hours a day (mean exactly 3.0) in the supermarket; the earlier one is senior.
    ping("stockA", D(2024, 2, 1, 8, 0), "SUPERMARKET", 3.0, "general_worker")
    ping("stockA", D(2024, 2, 1, 11, 0), "SUPERMARKET", 3.0, "general_worker")
    ping("stockB", D(2024, 2, 2, 8, 0), "SUPERMARKET", 3.0, "senior_general_worker")
    ping("stockB", D(2024, 2, 2, 10, 59), "SUPERMARKET", 3.0, "senior_general_worker")
    ping("stockB", D(2024, 2, 3, 8, 0), "SUPERMARKET", 3.0, "senior_general_worker")
    ping("stockB", D(2024, 2, 3, 11, 1), "SUPERMARKET", 3.0, "senior_general_worker")
    ping("stockC", D(2024, 1, 30, 8, 0), "SUPERMARKET", 3.0, "general_worker")
    ping("stockC", D(2024, 1, 30, 8, 10), "SUPERMARKET", 3.0, "general_worker")
    # Short visits to restricted areas still make staff; tie between two home areas.
    ping("boss", D(2024, 3, 4, 9, 0), "HEAD_OFFICE", 2.0, "manager")
    ping("boss", D(2024, 3, 4, 9, 5), "HEAD_OFFICE", 2.0, "manager")
    ping("tied", D(2024, 3, 5, 9, 0), "PARKING", 2.0, "security_guy")
    ping("tied", D(2024, 3, 5, 13, 0), "BUTCHERY", 2.0, "security_guy")
    # Deliveries: warehouse pings at hours 4, 5, 7 and 8 on Mondays and Thursdays.
    ping("truck", D(2024, 3, 4, 4, 59), "WAREHOUSE", 20.0, "delivery_guy")
    ping("truck", D(2024, 3, 11, 5, 0), "WAREHOUSE", 20.0, "delivery_guy")
    ping("truck", D(2024, 3, 14, 7, 59), "WAREHOUSE", 20.0, "delivery_guy")
    ping("truck", D(2024, 3, 18, 8, 0), "WAREHOUSE", 20.0, "delivery_guy")
    ping("guard", D(2024, 3, 21, 6, 0), "PARKING", 50.0, "security_guy")  # Thursday, only security
    ping("guard", D(2024, 3, 25, 6, 0), "PARKING", 50.0, "security_guy")
    ping("cashier1", D(2024, 3, 25, 14, 0), "CASH_REGISTERS", 70.0, "cashier")  # Monday, open, no delivery
    ping("cashier1", D(2024, 3, 7, 14, 30), "CASH_REGISTERS", 9.0, "cashier")
    ping("cashier1", D(2024, 3, 7, 15, 30), "SUPERMARKET", 9.0, "cashier")
    # New Year: week 52/53 and week 0 of the next year.
    ping("newyear", D(2023, 12, 30, 10, 0), "SUPERMARKET", 5.0, "one_time_customer")
    ping("newyear", D(2023, 12, 31, 10, 0), "SUPERMARKET", 5.0, "one_time_customer")
    ping("newyear", D(2024, 1, 1, 10, 0), "SUPERMARKET", 5.0, "one_time_customer")
    ping("newyear", D(2022, 1, 1, 10, 0), "SUPERMARKET", 5.0, "one_time_customer")
    ping("newyear", D(2020, 12, 31, 10, 0), "SUPERMARKET", 5.0, "one_time_customer")
    ping("walker", D(2024, 3, 5, 16, 0), "SUPERMARKET", 5.0, "customer")
    # Pings without a timestamp.
    ping("timeless", None, "CASH_REGISTERS", 5.0, "one_time_customer")
    ping("timeless", None, "CASH_REGISTERS", 5.0, "one_time_customer")
    ping("gapdev", None, "CASH_REGISTERS", 5.0, "one_time_customer")
    # A ping without a device id.
    ping(None, D(2024, 3, 5, 16, 0), "SUPERMARKET", 5.0, "repeat_customer")
    return rows


def log_sales_rows():
    rows = []
    n = [0]

    def sale(cust, ts, total, method="physical_card", dwell=None):
        n[0] += 1
        rows.append((f"T{n[0]:03d}", cust, ts, total, method, dwell))

    thu, fri, mon, wed, sat = D(2024, 3, 7), D(2024, 3, 8), D(2024, 3, 4), D(2024, 3, 6), D(2024, 3, 9)
    # Customer means of exactly 300, 800 and 1139, and just above 1139.
    sale("c300", thu + 10 * 60 * M, 250.00, dwell=20)
    sale("c300", mon + 15 * 60 * M, 350.00, dwell=21)
    sale("c800", fri + 9 * 60 * M, 800.00, "mobile", 30)
    sale("c800", wed + 10 * 60 * M, 800.00, "mobile", 30)
    sale("c1139", mon + 14 * 60 * M, 1139.00, "cash", 40)
    sale("c1139", mon + 17 * 60 * M + 59 * M, 1139.00, "cash", 40)
    sale("c1140", sat + 11 * 60 * M, 1139.01, "cash", 40)
    sale("c1140", thu + 18 * 60 * M, 1139.01, "voucher", 40)
    # Dwell boundaries and non-positive totals; half-cent ratios to exercise rounding.
    for d, tot in ((0, 10.0), (1, 10.05), (2, 10.05), (4, 12.5), (5, 12.5), (119, 99.99), (120, 100.0), (121, 100.0), (179, 70.0), (180, 70.0)):
        sale("dwell", wed + (9 * 60 + d) * M, tot, dwell=d)
    sale("dwell", wed + 20 * 60 * M, 0.0, dwell=30)
    sale("dwell", wed + 20 * 60 * M + 5 * M, -15.0, dwell=30)
    sale("dwell", wed + 21 * 60 * M, 33.0, dwell=None)
    # Anonymous tickets on one day with gaps of 60:00 and 61:00 (one group per day), NULL method.
    for step in (0, 60, 121, 121):
        sale(None, thu + (9 * 60 + step) * M, 45.0, None)
    sale(None, thu + 22 * 60 * M, 20.0, "cash")
    # Devices that pay, a customer never seen by a device, and large tickets above the fence.
    sale("gapdev", mon + 23 * 60 * M, 60.0)
    sale("tworole", fri + 9 * 60 * M, 9000.0)
    sale("loyal", D(2024, 1, 2, 17, 30), 75.0)
    sale("almost", D(2024, 1, 3, 12, 30), 75.0)
    sale("ghost", sat + 12 * 60 * M, 8500.0)
    sale("ghost", sat + 13 * 60 * M, 10.0)
    sale(None, fri + 12 * 60 * M, 12000.0)
    sale("walker", wed + 16 * 60 * M, 55.55)
    # Totals below a cent, and tickets without a timestamp (each a visit of its own).
    sale("c3digits", wed + 12 * 60 * M, 12.345, dwell=5)
    sale("c3digits", wed + 12 * 60 * M, 12.345, dwell=5)
    sale("fraction", sat + 12 * 60 * M, 9000.000004)
    sale("fraction", sat + 12 * 60 * M, 9000.000003)
    for who in ("undated", "undated", "undated", "walker", None, None):
        sale(who, None, 1.5)
    for k in range(12):
        sale(f"r{k:02d}", D(2024, 2, 1 + k, 8 + k) + k * M, 40.0 + 7.25 * k, "physical_card", 10 + k)
    return rows


CITY_ROWS = [
    (" NATION_15 ", 60156),
    (" Alpha ", 50000),
    ("Beta", 0),
    (" Gamma", 9000),
    ("Delta ", 20000),
    ("Epsilon", 10000),
    ("Zeta", 10001),
    ("\tEta\u00a0", 30000),
]
BRANCH_ROWS = [
    ("1", "NATION_15"),
    ("2", "NATION_15 "),
    ("3", "NATION_15"),
    ("4", "Alpha"),
    ("5", "Alpha "),
    ("6", "Beta"),
    ("7", " Gamma"),
    ("8", "Omega"),
    ("9", "Zeta"),
    ("10", "Epsilon"),
    ("11", "Eta\t"),
    ("12", "\u2003NATION_15\r\n"),
]

TABLES = {
    "geolocation": geolocation_rows,
    "log_sales": log_sales_rows,
    "city_population": lambda: CITY_ROWS,
    "supermarkets": lambda: BRANCH_ROWS,
}

_ARROW = {
    "string": pa.string(),
    "timestamp_ntz": pa.timestamp("us"),
    "double": pa.float64(),
    "int": pa.int32(),
    "bigint": pa.int64(),
}


def arrow_table(name: str) -> pa.Table:
    schema = schemas.SCHEMAS[name]
    rows = TABLES[name]()
    cols = {f.name: pa.array([r[i] for r in rows], type=_ARROW[f.dataType.simpleString()]) for i, f in enumerate(schema.fields)}
    return pa.table(cols)


def spark_tables(spark):
    from aislewise.sources.tables import RetailTables

    def df(name):
        return spark.createDataFrame(TABLES[name](), schemas.SCHEMAS[name])

    return RetailTables(geo=df("geolocation"), sales=df("log_sales"), city=df("city_population"), branches=df("supermarkets"))
