"""Canonical table schemas and the fixed vocabularies the queries test against."""

from __future__ import annotations

from pyspark.sql import types as T

GEOLOCATION = T.StructType(
    [
        T.StructField("device_id", T.StringType(), True),
        T.StructField("timestamp", T.TimestampNTZType(), True),
        T.StructField("area", T.StringType(), True),
        T.StructField("accuracy_m", T.DoubleType(), True),
        T.StructField("role", T.StringType(), True),
    ]
)

LOG_SALES = T.StructType(
    [
        T.StructField("sale_id", T.StringType(), True),
        T.StructField("customer_id", T.StringType(), True),
        T.StructField("timestamp", T.TimestampNTZType(), True),
        T.StructField("total", T.DoubleType(), True),
        T.StructField("payment_method", T.StringType(), True),
        T.StructField("dwell_minutes", T.IntegerType(), True),
    ]
)

CITY_POPULATION = T.StructType(
    [
        T.StructField("city_name", T.StringType(), True),
        T.StructField("total_population", T.LongType(), True),
    ]
)

SUPERMARKETS = T.StructType(
    [
        T.StructField("branch_id", T.StringType(), True),
        T.StructField("city", T.StringType(), True),
    ]
)

SCHEMAS = {
    "geolocation": GEOLOCATION,
    "log_sales": LOG_SALES,
    "city_population": CITY_POPULATION,
    "supermarkets": SUPERMARKETS,
}

# ---------------------------------------------------------------------------
# These strings must equal the ones the reference queries use.
# ---------------------------------------------------------------------------
STAFF_ROLES = (
    "manager",
    "cashier",
    "butcher",
    "general_worker",
    "senior_general_worker",
    "security_guy",
    "delivery_guy",
)
VISITOR_ROLES = ("repeat_customer", "one_time_customer", "not_paying")
FOOT_TRAFFIC_ROLES = ("customer", "repeat_customer", "one_time_customer", "not_paying")
CHECKOUT_ROLES = ("repeat_customer", "one_time_customer", "no_phone")
NO_PHONE = "no_phone"
WALK_IN = "No App (Walk-in)"
SEGMENTS = ("1. Small (<300)", "2. Medium (300-800)", "3. Large (800-1139)", "4. Whale (>1139)")
TIME_CATEGORIES = ("Peak (Thu-Fri)", "Off-Peak (Quiet)", "Regular")
# Area a static role is assumed to stand in when its ping is inaccurate.
STATIC_ROLE_AREA = {"security_guy": "PARKING", "butcher": "BUTCHERY", "cashier": "CASH_REGISTERS"}
# Home area -> staff role for devices classified as staff.
STAFF_AREA_ROLE = {
    "WAREHOUSE": "delivery_guy",
    "HEAD_OFFICE": "manager",
    "CASH_REGISTERS": "cashier",
    "BUTCHERY": "butcher",
    "PARKING": "security_guy",
}
