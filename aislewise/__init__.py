"""aislewise: retail footfall and point-of-sale analytics as Spark DataFrame jobs.

Inputs are two fact tables (``geolocation`` device pings and ``log_sales``
tickets) and two small city tables (``city_population`` and
``supermarkets``). Every operator takes DataFrames and returns a DataFrame;
nothing is collected to the driver. Results are lazy, except that role
classification and the visitor roster write one device-sized table first.
"""

from aislewise.sources.tables import RetailTables, load_canonical, derive_from_driver_tables

__all__ = ["RetailTables", "load_canonical", "derive_from_driver_tables"]
