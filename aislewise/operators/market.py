"""Market: saturation per city, households, competitors, market share.

City and branch tables are dimension-sized; joins between them are left to
Catalyst, which broadcasts a side when its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks it at run time).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.functions.numeric import ratio, round_half_up, share_pct

HOUSEHOLD_SIZE = 3.3  # persons per household, fixed value of the original analysis


def trim_name(col: str, all_whitespace: bool = True):
    """TRIM of a city name: any Unicode whitespace (tabs, no-break spaces, ...), as the original
    warehouse's TRIM does. Without ``all_whitespace`` blanks only, as Spark's ``trim``."""
    if all_whitespace:
        return F.regexp_replace(F.col(col), r"(?U)^\s+|\s+$", "")
    return F.trim(F.col(col))


def market_saturation(
    city: DataFrame, branches: DataFrame, min_population: int = 10000, all_whitespace: bool = True
) -> DataFrame:
    """Residents per supermarket for cities above ``min_population`` that have a branch."""
    pop = city.select(trim_name("city_name", all_whitespace).alias("city_name"), "total_population").where(
        F.col("total_population") > 0
    )
    supply = branches.groupBy(trim_name("city", all_whitespace).alias("city_name")).agg(
        F.count(F.lit(1)).alias("supermarket_count")
    )
    return (
        pop.join(supply, "city_name")
        .where(F.col("total_population") > min_population)
        .select(
            "city_name",
            "total_population",
            "supermarket_count",
            round_half_up(ratio("total_population", "supermarket_count"), 0).alias("people_per_supermarket"),
        )
        .orderBy("total_population")
    )


def estimated_households(
    city: DataFrame, name: str, household_size: float = HOUSEHOLD_SIZE, all_whitespace: bool = True
) -> DataFrame:
    """Population rows of the city (matched after trimming, returned untrimmed) and households."""
    return city.where(trim_name("city_name", all_whitespace) == name).select(
        "city_name",
        "total_population",
        round_half_up(F.col("total_population") / F.lit(float(household_size)), 0).alias("estimated_households"),
    )


def city_population_of(city: DataFrame, name: str, all_whitespace: bool = True) -> DataFrame:
    """One row: the population recorded for the city (largest if listed twice)."""
    return city.where(trim_name("city_name", all_whitespace) == name).agg(F.max("total_population").alias("__population"))


def residents_per_branch(
    branches: DataFrame,
    name: str,
    population: int | DataFrame | None = None,
    city: DataFrame | None = None,
    all_whitespace: bool = True,
) -> DataFrame:
    """Branches in the city grouped by the raw city spelling, and residents per branch.

    ``population`` is a number, or taken from ``city`` (the population table) when omitted.
    """
    counted = branches.where(trim_name("city", all_whitespace) == name).groupBy("city").agg(F.count(F.lit(1)).alias("number_of_competitors"))
    if population is None:
        if city is None:
            raise ValueError("give population or the city table")
        population = city_population_of(city, name, all_whitespace)
    if isinstance(population, DataFrame):
        counted = counted.crossJoin(F.broadcast(population))  # one row
        pop = F.col("__population")
    else:
        pop = F.lit(int(population))
    return counted.select(
        "city", "number_of_competitors", round_half_up(ratio(pop, "number_of_competitors"), 0).alias("residents_per_supermarket")
    )


def market_share(
    sales: DataFrame, city: DataFrame, name: str, household_size: float = HOUSEHOLD_SIZE, all_whitespace: bool = True
) -> DataFrame:
    """Identified customers as a percentage of the city's estimated households.

    The original states a 2.7% share of local households without giving the formula; this
    definition (distinct identified customers / estimated households * 100) is ours.
    """
    customers = sales.where(F.col("customer_id").isNotNull()).agg(
        F.countDistinct("customer_id").alias("identified_customers")
    )
    households = estimated_households(city, name, household_size, all_whitespace)
    return households.crossJoin(F.broadcast(customers)).select(  # one-row broadcast
        "city_name",
        "identified_customers",
        "estimated_households",
        round_half_up(share_pct("identified_customers", "estimated_households"), 2).alias("market_share_pct"),
    )
