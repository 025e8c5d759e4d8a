"""Units in which a technology's activity is measured."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.functions.relations import dimension, lookup_of
from loanlens.sources import schemas

# Sectors measured by emission intensity instead of output.
INTENSITY_SECTORS = ["aviation", "cement", "steel"]

# Unit per sector and technology, used where the caller passes none.
UNITS = [
    ("automotive", "electric", "cars produced"),
    ("automotive", "hybrid", "cars produced"),
    ("automotive", "ice", "cars produced"),
    ("aviation", "freight", "tonnes of CO2 per passenger per km travelled"),
    ("aviation", "passenger", "tonnes of CO2 per passenger per km travelled"),
    ("cement", "grinding", "tonnes of CO2 per tonne of cement"),
    ("cement", "integrated facility", "tonnes of CO2 per tonne of cement"),
    ("coal", "coal", "tonnes per year"),
    ("hdv", "electric", "vehicles produced"),
    ("hdv", "hybrid", "vehicles produced"),
    ("hdv", "ice", "vehicles produced"),
    ("oil and gas", "gas", "GJ"),
    ("oil and gas", "oil", "GJ"),
    ("power", "coalcap", "MW"),
    ("power", "gascap", "MW"),
    ("power", "hydrocap", "MW"),
    ("power", "nuclearcap", "MW"),
    ("power", "oilcap", "MW"),
    ("power", "renewablescap", "MW"),
    ("steel", "ac-electric arc furnace", "tonnes of CO2 per tonne of steel"),
    ("steel", "blast furnace", "tonnes of CO2 per tonne of steel"),
]


def constant(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A few fixed rows as part of the plan, which takes no Python worker to read."""
    values = ", ".join(str(row) for row in rows)
    return spark.sql(f"select * from values {values} as fixed({', '.join(columns)})")


def default_activity_units(spark: SparkSession) -> DataFrame:
    return constant(spark, UNITS, schemas.column_names(schemas.ACTIVITY_UNITS))


def units_of_technologies(
    spark: SparkSession, activity_units: DataFrame | None, unique: bool = False
) -> DataFrame:
    """The caller's units, or the built-in ones, to be joined by sector and technology.

    A technology with two units has two rows, which repeat its companies; with `unique`
    the plan fails instead.
    """
    if activity_units is None:
        return F.broadcast(default_activity_units(spark))
    units = activity_units.select("sector", "technology", "activity_unit")
    if not unique:
        return dimension(units)
    return lookup_of(
        units,
        ["sector", "technology"],
        "activity_unit",
        "more than one unit for the same sector and technology in `activity_units`",
    )


def units_of_sectors(spark: SparkSession, activity_units: DataFrame | None) -> DataFrame:
    """The same to be joined by sector; a sector with two units has two rows."""
    if activity_units is None:
        units = sorted({(sector, unit) for sector, _, unit in UNITS})
        return F.broadcast(constant(spark, units, ["sector", "activity_unit"]))
    return dimension(activity_units.select("sector", "activity_unit").distinct())


def build_activity_units(abcd: DataFrame) -> DataFrame:
    """Unit of every sector and technology in asset data.

    The emission unit for sectors measured by intensity, the production unit for all
    others.  A technology reported in two units has two rows, and a join with the table
    then repeats its companies, or fails if told to; `technologies_with_several_units`
    lists them.
    """
    unit = F.when(
        F.col("sector").isin(INTENSITY_SECTORS), F.col("emission_factor_unit")
    ).otherwise(F.col("production_unit"))
    return abcd.select("sector", "technology", unit.alias("activity_unit")).distinct()


def technologies_with_several_units(activity_units: DataFrame) -> DataFrame:
    """Sector and technology pairs that a join on them would repeat."""
    return (
        activity_units.groupBy("sector", "technology")
        .agg(F.count("*").alias("n_units"))
        .where(F.col("n_units") > 1)
    )
