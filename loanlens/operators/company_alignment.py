"""Alignment of companies, per sector, region and year.

The alignment metric is a company's total deviation from the scenario relative to the
scenario's own total.  Sectors with technology pathways add up technology deviations,
net or split by direction; sectors measured by emission intensity compare intensities.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.functions.missing import field, known_total, or_zero, ratio
from loanlens.functions.relations import match, with_group_totals, with_position
from loanlens.operators.activity_units import units_of_sectors
from loanlens.operators.checks import (
    flags,
    found,
    not_found,
    occurs,
    one_integer,
    one_of,
    one_text,
    scenarios_on_offer,
    validate_data_has_expected_cols,
)
from loanlens.operators.tech_deviation import (
    check_metrics_in_window,
    first_year_with_metrics,
    known_first_year,
    metric_years,
    restrict_to_scenario,
    spread_metrics,
    target_column,
)
from loanlens.sources import schemas

LEVELS = ("net", "bo_po")

# Directions by the name of the flag that says whether there are any.
DIRECTIONS = {"has_buildout": "buildout", "has_phaseout": "phaseout", "has_unknown": None}

# Not a company: the row of the whole market in emission intensity results.
MARKET = "market"

COMPANY_UNIT_YEAR = [
    "name_abcd",
    "scenario_source",
    "region",
    "sector",
    "activity_unit",
    "year",
]
UNIT_OF_ANALYSIS = [
    "name_abcd",
    "sector",
    "activity_unit",
    "region",
    "scenario_source",
    "scenario",
    "year",
]
OUTPUT = [*UNIT_OF_ANALYSIS, "direction", "total_deviation", "alignment_metric"]

DEVIATION_COLUMNS = [
    "sector",
    "technology",
    "year",
    "region",
    "scenario_source",
    "name_abcd",
    "projected",
    "direction",
    "total_tech_deviation",
    "activity_unit",
]


def arrange(df: DataFrame, *columns: str) -> DataFrame:
    """Sort for presentation, missing values last."""
    return df.orderBy(*[field(c).asc_nulls_last() for c in columns])


def arranged_as(
    df: DataFrame, columns: Sequence[str], arranged: bool, position: str | None
) -> DataFrame:
    """Sorted, or with each row's place in that order as a column.

    Places survive a shuffle or a write to many files.  Rows that tie are told apart by
    the other columns.
    """
    if position is not None:
        if position in df.columns:
            raise ValueError(f"There already is a column {position}.")
        rest = [c for c in df.columns if c not in columns]
        return with_position(df, [*columns, *rest], position, nulls_first=False)
    return arrange(df, *columns) if arranged else df


def scenario_total(target: str) -> Column:
    return known_total(field(target)).alias("net_absolute_scenario_value")


def beside_scenario_total(data: DataFrame, target: str) -> DataFrame:
    """Scenario total of the company's sector and unit in the year, on every row."""
    return with_group_totals(data, COMPANY_UNIT_YEAR, scenario_total(target))


def total_deviation_by_direction(data: DataFrame, target: str) -> DataFrame:
    """Deviations per direction beside the scenario total, in one aggregation.

    Scenario totals are summed per direction with the deviations and then over the
    directions of a company's sector, of which there are a handful.
    """
    by_direction = data.groupBy(*COMPANY_UNIT_YEAR, "direction").agg(
        known_total(F.col("total_tech_deviation")).alias("total_deviation"),
        scenario_total(target),
    )
    directions = Window.partitionBy(*COMPANY_UNIT_YEAR)
    return by_direction.withColumn(
        "net_absolute_scenario_value", F.sum("net_absolute_scenario_value").over(directions)
    )


def net_total_deviation(data: DataFrame, target: str) -> DataFrame:
    """The same over all directions."""
    return (
        data.groupBy(*COMPANY_UNIT_YEAR)
        .agg(
            known_total(F.col("total_tech_deviation")).alias("total_deviation"),
            scenario_total(target),
        )
        .withColumn("direction", F.lit("net"))
    )


def relative_to_scenario(data: DataFrame, scenario: str) -> DataFrame:
    """Deviation relative to the scenario total, in the output layout."""
    metric = ratio(F.col("total_deviation"), F.col("net_absolute_scenario_value"))
    return (
        data.withColumn("alignment_metric", metric)
        .withColumn("scenario", F.lit(scenario))
        .select(*OUTPUT)
    )


def in_all_directions(data: DataFrame) -> DataFrame:
    """Give every unit of analysis all directions found in `data`, zero where absent.

    Missing deviations and metrics of rows already there become zero as well.  What a
    unit has, and what the whole table has, are a flag per direction, so that neither
    grows with the rows: build-out, phase-out, and unknown.  Rows that are absent are made
    from the flags and put beside the others.
    """
    flags = {name: F.coalesce(F.bool_or(is_), F.lit(False)) for name, is_ in directions().items()}
    columns = [flag.alias(name) for name, flag in flags.items()]
    found = data.agg(F.struct(*columns)).scalar()
    units = data.groupBy(*UNIT_OF_ANALYSIS).agg(*columns)
    zero = F.lit(0.0)
    absent = [
        F.when(
            found[name] & ~F.col(name),
            F.struct(
                F.lit(DIRECTIONS[name]).cast("string").alias("direction"),
                zero.alias("total_deviation"),
                zero.alias("alignment_metric"),
            ),
        )
        for name in flags
    ]
    added = units.select(*UNIT_OF_ANALYSIS, F.inline(F.array_compact(F.array(*absent))))
    present = data.select(
        *UNIT_OF_ANALYSIS,
        "direction",
        or_zero(F.col("total_deviation")).alias("total_deviation"),
        or_zero(F.col("alignment_metric")).alias("alignment_metric"),
    )
    return present.unionByName(added)


def directions() -> dict[str, Column]:
    """What tells each direction's rows; any other direction is an error."""
    direction = F.col("direction")
    other = F.raise_error(F.concat(F.lit("`direction` is neither buildout nor phaseout: "), direction))
    known = F.when(
        direction.isNull() | direction.isin("buildout", "phaseout"), direction.isNull()
    ).otherwise(other.cast("boolean"))
    return {
        "has_buildout": direction.eqNullSafe("buildout"),
        "has_phaseout": direction.eqNullSafe("phaseout"),
        "has_unknown": known,
    }


def check_tms_input(data: DataFrame, scenario_source: str) -> None:
    if not occurs(data, F.col("scenario_source") == scenario_source):
        raise not_found(
            "scenario_source",
            "data$scenario_source",
            scenario_source,
            data.select("scenario_source"),
        )


def calculate_company_aggregate_alignment_tms(
    data: DataFrame,
    scenario_source: str = "geco_2021",
    scenario: str = "1.5c",
    level: str = "net",
    *,
    validate: bool = True,
    arranged: bool = False,
    position: str | None = None,
) -> DataFrame:
    """Alignment of companies in sectors with technology pathways.

    `level` is `net`, or `bo_po` for build-out and phase-out apart.  All scenario
    sources in `data` are kept; `scenario_source` must be one of them.  `arranged`
    sorts the result, which costs a shuffle of it; `position` instead names a column for
    each row's place in that order.
    """
    one_of("level", level, LEVELS)
    one_text("scenario_source", scenario_source)
    one_text("scenario", scenario)
    target = target_column(scenario)
    validate_data_has_expected_cols(data, [*DEVIATION_COLUMNS, target])
    if validate:
        check_tms_input(data, scenario_source)

    if level == "net":
        alignment = relative_to_scenario(
            net_total_deviation(data, target), scenario
        )
    else:
        alignment = in_all_directions(
            relative_to_scenario(
                total_deviation_by_direction(data, target), scenario
            )
        )
    order = ["sector", "name_abcd", "region", "year", "direction"]
    return arranged_as(alignment, order, arranged, position)


def intensity_beside_target(
    data: DataFrame,
    scenario_source: str,
    target: str,
    start_year: Column,
    time_frame: int,
) -> DataFrame:
    """Projected and target intensity of companies side by side."""
    companies = data.where(F.col("name_abcd") != MARKET)
    long = restrict_to_scenario(
        companies, scenario_source, "emission_factor_metric", target, start_year, time_frame
    )
    wide = spread_metrics(
        long, "emission_factor_metric", "emission_factor_value", ["projected", target]
    )
    return wide.withColumn("direction", F.lit("net"))


def with_intensity_gap(data: DataFrame) -> DataFrame:
    """Scenario less projected intensity: emitting less than the scenario is positive."""
    gap = F.col("projected") - F.col("net_absolute_scenario_value")
    return data.withColumn("total_deviation", gap * -1)


def companies_of(scenario_source: str) -> Column:
    return (F.col("scenario_source") == scenario_source) & (F.col("name_abcd") != MARKET)


def check_sda_input(
    data: DataFrame, scenario_source: str, scenario: str, time_frame: int
) -> int:
    target = target_column(scenario)
    metric = F.col("emission_factor_metric")
    offered = F.contains(metric, F.lit("target_")) & (
        F.replace(metric, F.lit("target_"), F.lit("")) == scenario
    )
    row = flags(
        data,
        source=found(F.col("scenario_source") == scenario_source),
        scenario=found(offered),
        **metric_years(companies_of(scenario_source), metric, target),
    )
    if not row["source"]:
        raise not_found(
            "scenario_source",
            "data$scenario_source",
            scenario_source,
            data.select("scenario_source"),
        )
    if not row["scenario"]:
        raise not_found(
            "scenario",
            "data$emission_factor_metric",
            scenario,
            scenarios_on_offer(data, "emission_factor_metric"),
        )
    check_metrics_in_window(row, ["projected", "target"], time_frame)
    return row["start"]


def calculate_company_aggregate_alignment_sda(
    data: DataFrame,
    scenario_source: str = "geco_2021",
    scenario: str = "1.5c",
    time_frame: int = 5,
    *,
    activity_units: DataFrame | None = None,
    validate: bool = True,
    arranged: bool = False,
    position: str | None = None,
    first_year: int | None = None,
) -> DataFrame:
    """Alignment of companies in sectors measured by emission intensity.

    `first_year`, if known, spares looking for it where `validate` is off.
    """
    one_text("scenario_source", scenario_source)
    one_text("scenario", scenario)
    one_integer("time_frame", time_frame)
    expected = schemas.column_names(schemas.INTENSITY_RESULTS)
    validate_data_has_expected_cols(data, expected)
    target = target_column(scenario)
    if validate:
        start_year = F.lit(check_sda_input(data, scenario_source, scenario, time_frame))
    else:
        rows, metric = companies_of(scenario_source), F.col("emission_factor_metric")
        start_year = (
            first_year_with_metrics(data, rows, metric, target, time_frame)
            if first_year is None
            else known_first_year(data, rows, metric, target, time_frame, first_year)
        )

    wide = intensity_beside_target(
        data, scenario_source, target, start_year, time_frame
    )
    measured = match(wide, units_of_sectors(data.sparkSession, activity_units), ["sector"])
    if set(data.columns) <= set(expected):
        # One row per company, sector, region and year: its own target is the total.
        totals = measured.withColumn("net_absolute_scenario_value", or_zero(field(target)))
    else:
        totals = beside_scenario_total(measured, target)
    alignment = relative_to_scenario(with_intensity_gap(totals), scenario)
    return arranged_as(alignment, ["sector", "name_abcd", "region", "year"], arranged, position)
