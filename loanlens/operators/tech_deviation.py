"""Technology deviations of companies in sectors with technology pathways.

For each company, technology, region and year: how far planned production is from the
scenario's, signed so that a positive deviation is an aligned one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.functions.missing import field, known, known_total, or_zero
from loanlens.functions.relations import BROADCAST_ROWS, lookup_of, match, values_differ
from loanlens.operators.activity_units import units_of_technologies
from loanlens.operators.checks import (
    ValueNotFound,
    flags,
    found,
    not_found,
    occurs,
    one_integer,
    one_of,
    one_text,
    quoted,
    scenarios_on_offer,
    validate_data_has_expected_cols,
)
from loanlens.sources import schemas

BRIDGE_TECHNOLOGIES = ("none", "gascap")

COMPANY_SECTOR_YEAR = ["name_abcd", "region", "scenario_source", "sector", "year"]
COMPANY_TECHNOLOGY_YEAR = [*COMPANY_SECTOR_YEAR, "technology"]
DIRECTION_KEYS = ["sector", "technology", "region"]

NO_METRIC = "no {} values for the scenario within the time frame."

# Columns that tell a projected row from its target row and so must not identify it.
NOT_IDENTIFYING = [
    "technology_share",
    "scope",
    "percentage_of_initial_production_by_scope",
]


def target_column(scenario: str) -> str:
    return f"target_{scenario}"


def first_year(data: DataFrame) -> Column:
    """Earliest year of the whole table, as a scalar subquery."""
    return data.agg(F.min("year")).scalar()


def metric_years(rows: Column, metric: Column, target: str) -> dict[str, Column]:
    """First year of the table, and of each metric among some of its rows."""
    return {
        "start": F.min("year"),
        "projected": F.min(F.when(rows & (metric == "projected"), F.col("year"))),
        "target": F.min(F.when(rows & (metric == target), F.col("year"))),
    }


def first_year_with_metrics(
    data: DataFrame, rows: Column, metric: Column, target: str, time_frame: int
) -> Column:
    """`first_year` that fails, when the plan runs, if a metric is absent from the window.

    Without a metric the analyses would return no rows, or meaningless ones, and say nothing.
    """
    years = metric_years(rows, metric, target)
    start = F.col("start")
    for name in ("projected", "target"):
        absent = F.col(name).isNull() | (F.col(name) > F.col("start") + time_frame)
        start = F.when(absent, F.raise_error(F.lit(NO_METRIC.format(name)))).otherwise(start)
    return data.agg(*[c.alias(name) for name, c in years.items()]).select(start).scalar()


def known_first_year(
    data: DataFrame,
    rows: Column,
    metric: Column,
    target: str,
    time_frame: int,
    year: int,
) -> Column:
    """The same where the first year is known: metrics are sought up to their first row."""
    start = F.lit(year)
    for name, value in (("target", target), ("projected", "projected")):
        in_window = F.col("year").between(year, year + time_frame)
        row = data.where(rows & (metric == value) & in_window).select(F.lit(1)).limit(1)
        message = F.raise_error(F.lit(NO_METRIC.format(name)))
        start = F.when(row.scalar().isNull(), message).otherwise(start)
    return start


def restrict_to_scenario(
    data: DataFrame,
    scenario_source: str,
    metric_column: str,
    target: str,
    start_year: Column,
    time_frame: int,
) -> DataFrame:
    """Rows of one scenario source, projected or target, within the time frame."""
    return data.where(
        (F.col("scenario_source") == scenario_source)
        & field(metric_column).isin("projected", target)
        & F.col("year").between(start_year, start_year + time_frame)
    )


def spread_metrics(
    data: DataFrame,
    names_from: str,
    values_from: str,
    metrics: list[str],
    cluster_by: list[str] | None = None,
) -> DataFrame:
    """One column per metric; all other columns identify a row.

    More than one value for a cell is an error, not an aggregation.  `cluster_by`
    lets the caller choose a coarser shuffle key that its next steps can reuse.
    """
    ids = [c for c in data.columns if c not in (names_from, values_from)]

    def cell(metric: str) -> Column:
        here = field(names_from) == metric
        several = F.raise_error(
            F.lit(f"values from `{values_from}` are not uniquely identified for {metric}")
        )
        return (
            F.when(F.count_if(here) > 1, several.cast("double"))
            .otherwise(F.max(F.when(here, known(field(values_from)))))
            .alias(metric)
        )

    if cluster_by:
        data = data.repartition(*[field(c) for c in cluster_by])
    return data.groupBy(*[field(c) for c in ids]).agg(*[cell(m) for m in metrics])


def directions_of_scenario(
    technology_direction: DataFrame, scenario_source: str, scenario: str
) -> DataFrame:
    """Build-out or phase-out sign per sector, technology and region, to be joined.

    `scenario` is searched as a regular expression.  If it matches several scenarios
    that give a technology different signs, rows would be counted twice; the plan then
    fails.  A repeated sign counts once.
    """
    matching = matching_directions(technology_direction, scenario_source, scenario)
    message = several_directions(scenario)
    return lookup_of(matching, DIRECTION_KEYS, "directional_dummy", message, BROADCAST_ROWS)


def matching_directions(
    technology_direction: DataFrame, scenario_source: str, scenario: str
) -> DataFrame:
    return technology_direction.where(
        (F.col("scenario_source") == scenario_source) & F.col("scenario").rlike(scenario)
    ).select(*DIRECTION_KEYS, "directional_dummy")


def several_directions(scenario: str) -> str:
    return (
        f"`scenario` {scenario!r} matches more than one direction for the same "
        "sector, technology and region in `technology_direction`."
    )


def without_idle_technologies(
    data: DataFrame, target: str, one_row_per_technology: bool = False
) -> DataFrame:
    """Drop a company's technology in a year without any planned or scenario output.

    With one row per company, technology, region and year the totals are the row's own
    values.  Otherwise they are summed up and the technologies to keep joined back.
    """
    if one_row_per_technology:
        return data.where((or_zero(F.col("projected")) != 0) | (or_zero(field(target)) != 0))
    active = (
        data.groupBy(*COMPANY_TECHNOLOGY_YEAR)
        .agg(
            known_total(F.col("projected")).alias("projected"),
            known_total(field(target)).alias("target"),
        )
        .where((F.col("projected") != 0) | (F.col("target") != 0))
        .select(*COMPANY_TECHNOLOGY_YEAR)
    )
    return match(data, active, COMPANY_TECHNOLOGY_YEAR, "left_semi", split_hot_keys=True)


def without_untargeted_sectors(
    data: DataFrame, target: str, one_row_per_technology: bool = False
) -> DataFrame:
    """Drop a company's sector in a year whose scenario output is zero.

    With one row per technology a sector's rows in a year are no more than the list of
    technologies, so a window does, over the partitioning that the step before left.
    Otherwise groups can be of any size, and the sectors to keep are joined back.
    """
    if one_row_per_technology:
        sector = Window.partitionBy(*COMPANY_SECTOR_YEAR)
        # `sum` over the window is NULL without any known target, and so fails `!= 0`.
        return (
            data.withColumn("_target", F.sum(known(field(target))).over(sector))
            .where(F.col("_target") != 0)
            .drop("_target")
        )
    targeted = (
        data.groupBy(*COMPANY_SECTOR_YEAR)
        .agg(known_total(field(target)).alias("target"))
        .where(F.col("target") != 0)
        .select(*COMPANY_SECTOR_YEAR)
    )
    return match(data, targeted, COMPANY_SECTOR_YEAR, "left_semi", split_hot_keys=True)


def with_signed_gap(data: DataFrame, target: str) -> DataFrame:
    """Planned less scenario output, signed by the technology's direction."""
    gap = F.col("projected") - field(target)
    return data.withColumn("total_tech_deviation", gap * F.col("directional_dummy"))


def with_direction_name(data: DataFrame) -> DataFrame:
    """Name the direction; an unknown sign stays unknown."""
    sign = F.col("directional_dummy")
    direction = F.when(sign == 1, "buildout").when(sign.isNotNull(), "phaseout")
    return data.withColumn("direction", direction).drop("directional_dummy")


def bridge_as_misaligned(data: DataFrame, bridge_tech: str) -> DataFrame:
    """Count any deviation of the bridge technology, either way, as misaligned.

    Rows without a technology are dropped.
    """
    deviation = F.col("total_tech_deviation")
    # Adding zero turns a negative zero into a plain one.
    capped = F.when(F.col("technology") == bridge_tech, F.abs(deviation) * -1 + 0.0)
    return data.where(F.col("technology").isNotNull()).withColumn(
        "total_tech_deviation", capped.otherwise(deviation)
    )


def output_beside_target(
    data: DataFrame,
    technology_direction: DataFrame,
    scenario_source: str,
    scenario: str,
    time_frame: int,
    start_year: Column | None = None,
    clustered: bool = False,
) -> DataFrame:
    """Projected and target output side by side, with the technology's sign.

    The signs are joined before the shuffle: rows of technologies without one never
    leave their task, and from then on the technologies of a company's sector in a
    year are limited by that list.
    """
    target = target_column(scenario)
    if start_year is None:
        in_source = F.col("scenario_source") == scenario_source
        start_year = first_year_with_metrics(
            data, in_source, F.col("metric"), target, time_frame
        )
    long = restrict_to_scenario(
        data, scenario_source, "metric", target, start_year, time_frame
    ).drop(*NOT_IDENTIFYING)
    signs = directions_of_scenario(technology_direction, scenario_source, scenario)
    signed = match(long, signs, DIRECTION_KEYS)
    wide = spread_metrics(
        signed,
        "metric",
        "production",
        ["projected", target],
        cluster_by=None
        if clustered or not is_one_row_per_technology(data)
        else COMPANY_SECTOR_YEAR,
    )
    ids = [c for c in long.columns if c not in ("metric", "production")]
    return wide.select(*[field(c) for c in [*ids, "projected", target]], "directional_dummy")


def is_one_row_per_technology(data: DataFrame) -> bool:
    """Whether nothing but company, technology, region, source and year identifies a row."""
    known_columns = {*COMPANY_TECHNOLOGY_YEAR, *NOT_IDENTIFYING, "metric", "production"}
    return set(data.columns) <= known_columns


def check_tech_deviation_input(
    data: DataFrame,
    technology_direction: DataFrame,
    scenario_source: str,
    scenario: str,
    time_frame: int,
) -> int:
    """Raise ValueError for a broken value contract; return the first year."""
    target = target_column(scenario)
    in_source = F.col("scenario_source") == scenario_source
    metric = F.col("metric")
    row = flags(
        data,
        source=found(in_source),
        scenario=found(metric.rlike(scenario)),
        **metric_years(in_source, metric, target),
    )
    if not row["source"]:
        raise not_found(
            "scenario_source", "data", scenario_source, data.select("scenario_source")
        )
    if not row["scenario"]:
        offered = scenarios_on_offer(data, "metric")
        raise ValueNotFound(
            "input value of `scenario` not matched to any sub string in `data$metric`. "
            f"You provided {scenario}. Available values are: {quoted(offered)}",
            offered.distinct(),
        )
    if not occurs(technology_direction, F.col("scenario_source") == scenario_source):
        raise not_found(
            "scenario_source",
            "technology_direction",
            scenario_source,
            technology_direction.select("scenario_source"),
        )
    if not occurs(technology_direction, F.col("scenario") == scenario):
        raise not_found(
            "scenario", "technology_direction", scenario, technology_direction.select("scenario")
        )
    signs = matching_directions(technology_direction, scenario_source, scenario)
    sign = F.col("directional_dummy")
    per_technology = signs.groupBy(*DIRECTION_KEYS).agg(values_differ(sign).alias("differ"))
    if occurs(per_technology, F.col("differ")):
        raise ValueError(several_directions(scenario))
    check_metrics_in_window(row, ["projected", "target"], time_frame)
    return row["start"]


def check_metrics_in_window(row, metrics: list[str], time_frame: int) -> None:
    """Each metric's first year, in `row`, must lie in the time frame from `row.start`."""
    for name in metrics:
        if row[name] is None or row[name] > row["start"] + time_frame:
            raise ValueError(NO_METRIC.format(name))


def calculate_company_tech_deviation(
    data: DataFrame,
    technology_direction: DataFrame,
    scenario_source: str = "geco_2021",
    scenario: str = "1.5c",
    bridge_tech: str = "none",
    time_frame: int = 5,
    *,
    activity_units: DataFrame | None = None,
    validate: bool = True,
    unique_units: bool = False,
    clustered: bool = False,
    first_year: int | None = None,
) -> DataFrame:
    """Technology deviations of companies against one scenario.

    `data` holds production by metric, `technology_direction` the sign of each
    technology.  `activity_units` gives the unit of each sector and technology; rows
    without one are dropped.  `validate=False` skips the value checks, which read
    four columns of `data` once; a metric that is absent then fails when the plan runs.
    A technology with two units has its rows twice; with `unique_units` the plan fails.
    `clustered` says that `data` is stored by `sources.storage.store_clustered`, so that
    it need not be shuffled; `first_year`, if known, spares looking for it.
    """
    one_of("bridge_tech", bridge_tech, BRIDGE_TECHNOLOGIES)
    one_text("scenario_source", scenario_source)
    one_text("scenario", scenario)
    one_integer("time_frame", time_frame)
    validate_data_has_expected_cols(data, schemas.column_names(schemas.TECHNOLOGY_RESULTS))
    validate_data_has_expected_cols(
        technology_direction, schemas.column_names(schemas.TECHNOLOGY_DIRECTION)
    )
    start_year = None
    if validate:
        start_year = F.lit(
            check_tech_deviation_input(
                data, technology_direction, scenario_source, scenario, time_frame
            )
        )
    target = target_column(scenario)
    if start_year is None and first_year is not None:
        in_source = F.col("scenario_source") == scenario_source
        start_year = known_first_year(
            data, in_source, F.col("metric"), target, time_frame, first_year
        )
    wide = output_beside_target(
        data, technology_direction, scenario_source, scenario, time_frame, start_year, clustered
    )
    unique = is_one_row_per_technology(data)
    active = without_idle_technologies(wide, target, unique)
    kept = without_untargeted_sectors(active, target, unique)
    deviations = match(
        with_direction_name(with_signed_gap(kept, target)),
        units_of_technologies(data.sparkSession, activity_units, unique_units),
        ["sector", "technology"],
    )
    if bridge_tech != "none":
        deviations = bridge_as_misaligned(deviations, bridge_tech)
    return deviations
