"""DuckDB SQL that derives the four canonical views from the driver tables.

The oracle queries are independent SQL over the raw tables (``events``,
``orders``, ``nation``, ``supplier`` are views in the checker). Each oracle is
``WITH <these views>, <its own CTEs> SELECT ...``. The rules mirror
``aislewise.sources.tables`` (FIXTURES.md section C).
"""

from __future__ import annotations

BASE_VIEWS = """
geo_src AS (
  SELECT *,
         CAST(ts AS DATE) AS d,
         CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS sod,
         user_id % 5 = 0 AS is_staff,
         CASE CAST(floor(user_id / 5) AS BIGINT) % 7
           WHEN 0 THEN 'cashier' WHEN 1 THEN 'delivery_guy' WHEN 2 THEN 'security_guy'
           WHEN 3 THEN 'butcher' WHEN 4 THEN 'manager' WHEN 5 THEN 'general_worker'
           ELSE 'senior_general_worker' END AS staff_role
  FROM events
),
geolocation AS (
  SELECT
    CAST(user_id AS VARCHAR) AS device_id,
    CASE
      WHEN is_staff THEN CAST(d AS TIMESTAMP) + to_seconds(sod)
      WHEN user_id % 3 = 0 THEN CAST(d AS TIMESTAMP) + to_seconds(28800 + (user_id % 10) * 3600 + CAST(floor(sod / 12) AS BIGINT))
      ELSE CAST(DATE '2024-01-01' + 3 * CAST(d - DATE '2024-01-01' AS INTEGER) AS TIMESTAMP)
           + to_seconds(28800 + (user_id % 10) * 3600 + CAST(floor(sod / 12) AS BIGINT))
    END AS "timestamp",
    CASE
      WHEN is_staff AND event_id % 5 <> 0 THEN
        CASE staff_role WHEN 'cashier' THEN 'CASH_REGISTERS' WHEN 'delivery_guy' THEN 'WAREHOUSE'
          WHEN 'security_guy' THEN 'PARKING' WHEN 'butcher' THEN 'BUTCHERY' WHEN 'manager' THEN 'HEAD_OFFICE'
          ELSE 'SUPERMARKET' END
      WHEN event_id % 10 <= 3 THEN 'SUPERMARKET'
      WHEN event_id % 10 <= 7 THEN 'CASH_REGISTERS'
      WHEN event_id % 10 = 8 THEN 'PARKING'
      ELSE 'BUTCHERY'
    END AS area,
    CAST(value AS DOUBLE) AS accuracy_m,
    CASE
      WHEN is_staff THEN staff_role
      WHEN user_id % 50 = 49 THEN NULL
      WHEN user_id % 3 = 0 THEN 'one_time_customer'
      WHEN user_id % 3 = 1 THEN 'repeat_customer'
      ELSE 'not_paying'
    END AS role
  FROM geo_src
),
sales_src AS (
  SELECT *,
         floor(o_totalprice * (o_custkey % 5 + 1) * (CASE WHEN o_orderkey % 29 = 0 THEN 5 ELSE 1 END) / 12) / 100 AS tot
  FROM orders
),
log_sales AS (
  SELECT
    'S' || CAST(o_orderkey AS VARCHAR) AS sale_id,
    CASE WHEN o_custkey % 3 = 2 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS customer_id,
    CAST(o_orderdate AS TIMESTAMP) + to_seconds(28800 + (o_orderkey * 7919) % 50400) AS "timestamp",
    CAST(tot AS DOUBLE) AS total,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'physical_card' WHEN '2-HIGH' THEN 'physical_card'
      WHEN '3-MEDIUM' THEN 'cash' WHEN '4-NOT SPECIFIED' THEN 'mobile' WHEN '5-LOW' THEN 'voucher' END AS payment_method,
    CASE WHEN o_custkey % 3 = 2 THEN NULL ELSE CAST(floor(tot / 10) + o_orderkey % 17 AS INTEGER) END AS dwell_minutes
  FROM sales_src
),
city_population AS (
  SELECT ' ' || n_name || ' ' AS city_name, CAST(n_nationkey * 1500 AS BIGINT) AS total_population FROM nation
),
supermarkets AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS branch_id,
         CASE WHEN s_suppkey % 2 = 0 THEN n_name || ' ' ELSE n_name END AS city
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
)"""


def with_views(body: str) -> str:
    """``body`` is either ``SELECT ...`` or ``<cte>, <cte> SELECT ...`` without a leading WITH."""
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return f"WITH {BASE_VIEWS.strip()}\n{body}"
    return f"WITH {BASE_VIEWS.strip()},\n{body}"
