"""Compute every KPI and write them as Parquet marts.

    python -m aislewise --canonical DIR --out DIR [--only name,name]
    python -m aislewise --driver-tables /root/testdata/sf0.01 --out DIR

``--canonical`` expects sub-folders geolocation, log_sales, city_population and supermarkets.
Under spark-submit the cluster's session is used; otherwise a local one is started.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="aislewise")
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--canonical", help="folder with the four canonical tables as Parquet")
    src.add_argument("--driver-tables", help="folder with the TPC-H-like test tables")
    ap.add_argument("--out", required=True, help="folder for the KPI marts")
    ap.add_argument("--only", default="", help="comma-separated KPI names (default: all)")
    args = ap.parse_args(argv)

    from aislewise.session import local_session
    from aislewise.sources.marts import build_kpis, write_kpi_marts
    from aislewise.sources.tables import derive_from_driver_tables, load_canonical

    spark = SparkSession.getActiveSession() or local_session()
    if args.canonical:
        names = ("geolocation", "log_sales", "city_population", "supermarkets")
        tables = load_canonical(spark, {n: os.path.join(args.canonical, n) for n in names})
    else:
        tables = derive_from_driver_tables(spark, args.driver_tables, materialize=True)
    only = {n for n in args.only.split(",") if n} or None
    for path in write_kpi_marts(build_kpis(tables, only), args.out):
        print(path)


if __name__ == "__main__":
    main()
