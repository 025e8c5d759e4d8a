"""Value checks of all inputs as a data quality report."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.operators.activity_units import constant
from loanlens.operators.checks import found
from loanlens.operators.company_alignment import DEVIATION_COLUMNS
from loanlens.operators.loanbook import ALIGNMENT_COLUMNS
from loanlens.operators.tech_deviation import target_column
from loanlens.sources import schemas

REPORT = ["input", "check", "argument", "requested", "available", "ok"]


def checked(
    df: DataFrame, name: str, checks: list[tuple[str, object, Column, Column]]
) -> DataFrame:
    """One row per (argument, requested value, values on offer, match), one pass over `df`."""
    aggregates = []
    for i, (_, _, offered, matches) in enumerate(checks):
        aggregates += [
            F.count_distinct(offered).alias(f"n_{i}"),
            found(matches).alias(f"ok_{i}"),
        ]
    rows = [
        F.struct(
            F.lit(name).alias("input"),
            F.lit(argument).alias("argument"),
            F.lit(str(requested)).alias("requested"),
            F.col(f"n_{i}").alias("n_available"),
            F.col(f"ok_{i}").alias("ok"),
        )
        for i, (argument, requested, _, _) in enumerate(checks)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def scenario_of(metric: str) -> Column:
    """Scenario a target metric is about; NULL for other metrics."""
    named = F.replace(F.col(metric), F.lit("target_"), F.lit(""))
    return F.when(F.contains(F.col(metric), F.lit("target_")), named)


class ValueCheck(NamedTuple):
    """A check of an argument against what an input offers in each row."""

    check: str
    argument: str
    requested: object
    offered: Column
    matches: Column


def offered_values(df: DataFrame, name: str, checks: list[ValueCheck]) -> DataFrame:
    """Every distinct value on offer as a row; one row without a value if there is none.

    All checks of an input share one pass: a row becomes one per check, and repeats are
    combined before they are shuffled.  Values may be many; checks are few.
    """
    told = F.array(
        *[
            F.struct(
                F.lit(i).alias("number"),
                c.offered.cast("string").alias("available"),
                F.coalesce(c.matches, F.lit(False)).alias("hit"),
            )
            for i, c in enumerate(checks)
        ]
    )
    values = (
        df.select(F.inline(told))
        .where(F.col("available").isNotNull() | F.col("hit"))
        .groupBy("number", "available")
        .agg(F.bool_or("hit").alias("hit"))
    )
    met = values.groupBy("number").agg(F.bool_or("hit").alias("ok"))
    listed = constant(
        df.sparkSession,
        [(i, name, c.check, c.argument, str(c.requested)) for i, c in enumerate(checks)],
        ["number", "input", "check", "argument", "requested"],
    )
    # As many rows as there are checks.
    outcome = listed.join(F.broadcast(met), "number", "left")
    # A value's own hit says nothing new, but with it both uses read the same exchange.
    ok = F.coalesce("ok", F.lit(False)) | F.coalesce("hit", F.lit(False))
    return (
        F.broadcast(outcome).join(values, "number", "left").select(*REPORT[:-1], ok.alias("ok"))
    )


def column_checks(df: DataFrame, name: str, check: str, expected: Iterable[str]) -> list[tuple]:
    """A row for every column that an input needs."""
    return [
        (name, check, "columns", c, c if c in df.columns else None, c in df.columns)
        for c in dict.fromkeys(expected)
    ]


def contract_values(
    *,
    tms_results: DataFrame,
    technology_direction: DataFrame,
    deviations: DataFrame,
    sda_results: DataFrame,
    alignment: DataFrame,
    matched: DataFrame,
    abcd: DataFrame,
    region_isos: DataFrame,
    scenario_source: str,
    scenario: str,
    start_year: int,
    benchmark_region: str,
    by: Sequence[str] = (),
) -> DataFrame:
    """All checks that the analyses make of columns and values, with all that is on offer.

    Columns: input, check, argument, requested, available, ok.  A check of values has a
    row per distinct value on offer, a check of columns a row per column asked for, and
    `ok` says whether the check as a whole, or the column, is met.  `check` names what
    would fail: V2 and V7 to V14 without value checks are column contracts, V13 is that
    `by` names no column the analysis needs itself.
    """
    spark = tms_results.sparkSession
    names, target = schemas.column_names, target_column(scenario)
    critical = {*ALIGNMENT_COLUMNS, *names(schemas.MATCHED_LOANS)}
    columns = [
        *column_checks(tms_results, "tms_results", "V2", names(schemas.TECHNOLOGY_RESULTS)),
        *column_checks(
            technology_direction, "technology_direction", "V2", names(schemas.TECHNOLOGY_DIRECTION)
        ),
        *column_checks(deviations, "deviations", "V7", [*DEVIATION_COLUMNS, target]),
        *column_checks(sda_results, "sda_results", "V9", names(schemas.INTENSITY_RESULTS)),
        *column_checks(alignment, "alignment", "V12", ALIGNMENT_COLUMNS),
        *column_checks(matched, "matched", "V12", [*names(schemas.MATCHED_LOANS), *by]),
        *(("matched", "V13", "by", c, c, c not in critical) for c in dict.fromkeys(by)),
        *column_checks(abcd, "abcd", "V14", names(schemas.ASSET_DATA)),
        *column_checks(region_isos, "region_isos", "V14", names(schemas.REGION_ISOS)),
    ]
    source, metric = F.col("scenario_source"), F.col("metric")
    intensity = scenario_of("emission_factor_metric")
    in_source = F.col("source") == scenario_source

    def has_source(check: str) -> ValueCheck:
        return ValueCheck(
            check, "scenario_source", scenario_source, source, source == scenario_source
        )

    def has(check: str, argument: str, value: object, offered: Column) -> ValueCheck:
        return ValueCheck(check, argument, value, offered, offered == value)

    values = [
        offered_values(
            tms_results,
            "tms_results",
            [
                has_source("V3"),
                ValueCheck(
                    "V4", "scenario", scenario, scenario_of("metric"), metric.rlike(scenario)
                ),
            ],
        ),
        offered_values(
            technology_direction,
            "technology_direction",
            [has_source("V5"), has("V6", "scenario", scenario, F.col("scenario"))],
        ),
        offered_values(deviations, "deviations", [has_source("V8")]),
        offered_values(
            sda_results,
            "sda_results",
            [has_source("V10"), has("V11", "scenario", scenario, intensity)],
        ),
        offered_values(
            region_isos,
            "region_isos",
            [
                has("V15", "scenario_source", scenario_source, F.col("source")),
                has(
                    "V16", "benchmark_region", benchmark_region, F.when(in_source, F.col("region"))
                ),
            ],
        ),
        offered_values(abcd, "abcd", [has("V17", "start_year", start_year, F.col("year"))]),
    ]
    fixed = spark.createDataFrame(
        columns, "input string, check string, argument string, requested string,"
        " available string, ok boolean",
    )
    return reduce(DataFrame.unionByName, values, fixed)


def contract_report(
    *,
    tms_results: DataFrame,
    technology_direction: DataFrame,
    sda_results: DataFrame,
    abcd: DataFrame,
    region_isos: DataFrame,
    scenario_source: str,
    scenario: str,
    start_year: int,
    benchmark_region: str,
) -> DataFrame:
    """Whether each argument's value occurs in the inputs, and among how many.

    Columns: input, argument, requested, n_available, ok.  A lazy counterpart of the
    checks the analyses make, for looking at many runs before starting any.
    """
    source = F.col("scenario_source")
    in_source = F.col("source") == scenario_source
    region = F.col("region")
    parts = [
        checked(
            tms_results,
            "tms_results",
            [
                ("scenario_source", scenario_source, source, source == scenario_source),
                ("scenario", scenario, scenario_of("metric"), F.col("metric").rlike(scenario)),
            ],
        ),
        checked(
            technology_direction,
            "technology_direction",
            [
                ("scenario_source", scenario_source, source, source == scenario_source),
                ("scenario", scenario, F.col("scenario"), F.col("scenario") == scenario),
            ],
        ),
        checked(
            sda_results,
            "sda_results",
            [
                ("scenario_source", scenario_source, source, source == scenario_source),
                (
                    "scenario",
                    scenario,
                    scenario_of("emission_factor_metric"),
                    scenario_of("emission_factor_metric") == scenario,
                ),
            ],
        ),
        checked(
            region_isos,
            "region_isos",
            [
                ("scenario_source", scenario_source, F.col("source"), in_source),
                (
                    "benchmark_region",
                    benchmark_region,
                    F.when(in_source, region),
                    in_source & (region == benchmark_region),
                ),
            ],
        ),
        checked(
            abcd,
            "abcd",
            [("start_year", start_year, F.col("year"), F.col("year") == start_year)],
        ),
    ]
    return reduce(DataFrame.unionByName, parts)
