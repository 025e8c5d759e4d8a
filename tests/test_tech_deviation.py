"""Technology deviations: worked examples, missing values and contracts."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loanlens import calculate_company_tech_deviation
from loanlens.operators import tech_deviation
from loanlens.operators.checks import ValueNotFound
from loanlens.sources import schemas
from tests.conftest import records

WIDE = (
    "sector string, technology string, year int, region string, scenario_source string, "
    "name_abcd string, projected double, target_scenario double"
)
TARGET = "target_scenario"


def long_row(technology, metric, production, **changes):
    row = {
        "sector": "power",
        "technology": technology,
        "year": 2027,
        "region": "global",
        "scenario_source": "source",
        "name_abcd": "company",
        "metric": metric,
        "production": production,
        "technology_share": 0.25,
        "scope": "sector",
        # Differs between projected and target rows, as in real results.
        "percentage_of_initial_production_by_scope": 0.005 if metric == "projected" else 0.01,
    }
    row.update(changes)
    return tuple(row.values())


# Too little hydro, little coal, too much oil.
RESULTS = [
    long_row("hydrocap", "projected", 12.0),
    long_row("hydrocap", TARGET, 18.0),
    long_row("coalcap", "projected", 30.0),
    long_row("coalcap", TARGET, 45.0),
    long_row("oilcap", "projected", 8.0),
    long_row("oilcap", TARGET, 2.0),
]
DIRECTIONS = [
    ("source", "scenario", "power", technology, "global", sign)
    for technology, sign in [("hydrocap", 1.0), ("coalcap", -1.0), ("oilcap", -1.0)]
]
ARGUMENTS = {"scenario_source": "source", "scenario": "scenario"}
OUTCOME = ["technology", "total_tech_deviation", "direction", "activity_unit"]


@pytest.fixture
def deviate(table):
    def run(results=RESULTS, directions=DIRECTIONS, units=None, **arguments):
        return calculate_company_tech_deviation(
            table(results, schemas.TECHNOLOGY_RESULTS),
            table(directions, schemas.TECHNOLOGY_DIRECTION),
            activity_units=table(units, schemas.ACTIVITY_UNITS) if units is not None else None,
            **{**ARGUMENTS, **arguments},
        )

    return run


@pytest.mark.parametrize("validate", [True, False])
def test_worked_example(deviate, validate):
    result = deviate(validate=validate)
    assert result.columns == [
        "sector",
        "technology",
        "year",
        "region",
        "scenario_source",
        "name_abcd",
        "projected",
        TARGET,
        "total_tech_deviation",
        "direction",
        "activity_unit",
    ]
    assert records(result, *OUTCOME) == [
        ("coalcap", 15.0, "phaseout", "MW"),
        ("hydrocap", -6.0, "buildout", "MW"),
        ("oilcap", -6.0, "phaseout", "MW"),
    ]


def test_other_sources_metrics_and_years_are_left_out(deviate):
    extra = [
        long_row("hydrocap", "projected", 1.0, scenario_source="other"),
        long_row("hydrocap", "target_other", 1.0),
        long_row("hydrocap", "projected", 1.0, year=2033),
        long_row("hydrocap", TARGET, 1.0, year=2033),
    ]
    assert records(deviate(RESULTS + extra), *OUTCOME) == records(deviate(), *OUTCOME)


@pytest.mark.parametrize("validate", [True, False])
def test_the_window_starts_at_the_first_year_of_the_whole_table(deviate, validate):
    earlier = long_row("hydrocap", "projected", 1.0, scenario_source="other", year=2024)
    late = [
        long_row("hydrocap", "projected", 30.0, year=2029),
        long_row("hydrocap", TARGET, 20.0, year=2029),
        long_row("hydrocap", "projected", 30.0, year=2030),
        long_row("hydrocap", TARGET, 20.0, year=2030),
    ]
    result = deviate([*RESULTS, earlier, *late], validate=validate)
    assert {r["year"] for r in result.collect()} == {2027, 2029}


def power_rows(pairs):
    """Planned and scenario output of the technologies of one company."""
    return [
        ("power", technology, 2027, "global", "source", "company", *pair)
        for technology, pair in zip(["hydrocap", "coalcap", "oilcap"], pairs, strict=True)
    ]


@pytest.mark.parametrize(
    "pairs, kept",
    [
        ([(12.0, 18.0), (0.0, 0.0), (8.0, 2.0)], 2),
        ([(12.0, 0.0), (0.0, 7.0), (0.0, 0.0)], 2),
        ([(5.0, 5.0), (None, 2.0), (1.0, None)], 3),
        ([(None, None), (0.0, None), (None, 0.0)], 0),
    ],
)
def test_technologies_without_plan_and_target_are_removed(table, pairs, kept):
    result = tech_deviation.without_idle_technologies(table(power_rows(pairs), WIDE), TARGET)
    assert result.count() == kept


@pytest.mark.parametrize(
    "pairs, kept",
    [
        ([(12.0, 0.0), (3.0, 0.0), (1.0, 0.0)], 0),
        ([(12.0, 0.0), (0.0, 0.0), (0.0, 7.0)], 3),
        ([(4.0, None), (4.0, 0.0), (4.0, 1.0)], 3),
        ([(4.0, None), (None, None), (0.0, None)], 0),
    ],
)
def test_sectors_without_target_are_removed(table, pairs, kept):
    result = tech_deviation.without_untargeted_sectors(table(power_rows(pairs), WIDE), TARGET)
    assert result.count() == kept


def test_removals_are_the_same_for_one_row_per_technology(spark):
    wide = spark.range(4000).selectExpr(
        "if(id % 3 = 0, 'power', null) as sector",
        "element_at(array('a', 'b', null, 'c'), cast(id % 4 + 1 as int)) as technology",
        "cast(2022 + id div 4 % 5 as int) as year",
        "if(id % 7 = 0, null, 'r') as region",
        "'s' as scenario_source",
        "concat('c', id div 20) as name_abcd",
        "if(id % 5 < 2, null, cast(id % 5 - 2 as double)) as projected",
        "if(id % 11 < 6, 0D, if(id % 11 = 6, null, 3D)) as target_scenario",
    ).dropDuplicates(tech_deviation.COMPANY_TECHNOLOGY_YEAR)

    def removed(unique):
        active = tech_deviation.without_idle_technologies(wide, TARGET, unique)
        return records(tech_deviation.without_untargeted_sectors(active, TARGET, unique))

    assert 0 < len(removed(False)) < wide.count()
    assert removed(True) == removed(False)


def test_extra_columns_identify_rows(table, deviate):
    """Two plants of a company stay apart but count towards the company's totals."""
    schema = schemas.TECHNOLOGY_RESULTS + ", plant string"
    rows = [
        (*long_row("hydrocap", "projected", 0.0), "p1"),
        (*long_row("hydrocap", TARGET, 0.0), "p1"),
        (*long_row("hydrocap", "projected", 9.0), "p2"),
        (*long_row("hydrocap", TARGET, 4.0), "p2"),
        (*long_row("coalcap", "projected", 0.0), "p1"),
        (*long_row("coalcap", TARGET, 0.0), "p2"),
    ]
    result = calculate_company_tech_deviation(
        table(rows, schema), table(DIRECTIONS, schemas.TECHNOLOGY_DIRECTION), **ARGUMENTS
    )
    # Coal is idle in both plants; hydro is not, so its empty plant is kept.
    assert records(result, "technology", "plant", "total_tech_deviation") == [
        ("hydrocap", "p1", 0.0),
        ("hydrocap", "p2", 5.0),
    ]


def test_missing_region_matches_missing_region(deviate):
    results = [long_row("hydrocap", m, v, region=None) for m, v in [("projected", 3.0), (TARGET, 1.0)]]
    directions = [("source", "scenario", "power", "hydrocap", None, 1.0)]
    assert records(deviate(results, directions), "region", "total_tech_deviation") == [(None, 2.0)]


def test_unknown_sign_leaves_direction_unknown(deviate):
    directions = [("source", "scenario", "power", "hydrocap", "global", None), *DIRECTIONS[1:]]
    assert records(deviate(directions=directions), *OUTCOME[:3]) == [
        ("coalcap", 15.0, "phaseout"),
        ("hydrocap", None, None),
        ("oilcap", -6.0, "phaseout"),
    ]


def test_missing_plan_has_no_deviation(deviate):
    results = [r for r in RESULTS if r[1:7:5] != ("hydrocap", "projected")]
    assert records(deviate(results), "technology", "total_tech_deviation") == [
        ("coalcap", 15.0),
        ("hydrocap", None),
        ("oilcap", -6.0),
    ]


def test_nan_is_read_as_missing(deviate):
    results = [long_row("hydrocap", "projected", float("nan")), *RESULTS[1:]]
    assert records(deviate(results), "technology", "projected") == [
        ("coalcap", 30.0),
        ("hydrocap", None),
        ("oilcap", 8.0),
    ]


def test_technologies_without_unit_are_dropped(deviate):
    units = [("power", "oilcap", "GW")]
    assert records(deviate(units=units), *OUTCOME) == [("oilcap", -6.0, "phaseout", "GW")]


def test_technologies_without_unit_still_count_for_the_sector(deviate):
    results = [
        long_row("coalcap", "projected", 6.0),
        long_row("coalcap", TARGET, 0.0),
        long_row("hydrocap", "projected", 1.0),
        long_row("hydrocap", TARGET, 1.0),
    ]
    assert deviate(results, units=[("power", "coalcap", "GW")]).count() == 1


@pytest.mark.parametrize("over, under", [(10.0, -10.0)])
def test_bridge_cap(table, over, under):
    rows = [("gascap", over), ("gascap", under), ("gascap", 0.0), ("coalcap", over), (None, over)]
    df = table(rows, "technology string, total_tech_deviation double")
    result = tech_deviation.bridge_as_misaligned(df, "gascap")
    assert records(result) == [
        ("coalcap", 10.0),
        ("gascap", -10.0),
        ("gascap", -10.0),
        ("gascap", 0.0),
    ]


def test_direction_and_deviation_steps(table):
    df = table([(4.0, 7.0, -1.0), (4.0, 7.0, 1.0)], "projected double, target_scenario double, directional_dummy double")
    result = tech_deviation.with_direction_name(tech_deviation.with_signed_gap(df, TARGET))
    assert records(result, "total_tech_deviation", "direction") == [
        (-3.0, "buildout"),
        (3.0, "phaseout"),
    ]


def test_two_values_for_a_cell_are_an_error(deviate):
    with pytest.raises(PySparkException, match="not uniquely identified"):
        deviate([*RESULTS, RESULTS[0]]).collect()


def test_scenario_pattern_matching_two_scenarios_is_an_error(deviate):
    with pytest.raises(ValueError, match="more than one direction"):
        deviate(directions=[*DIRECTIONS, ("source", "scenario_x", *DIRECTIONS[0][2:5], -1.0)])


def test_two_signs_fail_when_the_plan_runs(deviate):
    twice = [*DIRECTIONS, ("source", "scenario_x", *DIRECTIONS[0][2:5], -1.0)]
    missing = [*DIRECTIONS, ("source", "scenario_x", *DIRECTIONS[0][2:5], None)]
    for directions in (twice, missing):
        deviations = deviate(directions=directions, validate=False)
        with pytest.raises(PySparkException, match="more than one direction"):
            deviations.collect()


def test_two_units_of_a_technology_fail_when_the_plan_runs_if_told_to(deviate):
    units = [("power", "oilcap", "GW"), ("power", "oilcap", "MW")]
    with pytest.raises(PySparkException, match="more than one unit"):
        deviate(units=units, unique_units=True).collect()
    assert deviate(units=units).count() == 2
    again = [("power", "oilcap", "GW")] * 2
    once = deviate(units=again, unique_units=True)
    assert records(once, *OUTCOME) == [("oilcap", -6.0, "phaseout", "GW")]


def test_an_unmatched_scenario_lists_all_on_offer(deviate):
    many = [long_row("oilcap", f"target_{i:02}", 1.0) for i in range(30)]
    with pytest.raises(ValueNotFound, match=r"31 in all") as error:
        deviate([*RESULTS, *many], scenario="bad")
    assert error.value.available.count() == 31


def test_a_repeated_sign_counts_once(deviate):
    again = [*DIRECTIONS, DIRECTIONS[0], ("source", "scenario_x", *DIRECTIONS[1][2:])]
    assert records(deviate(directions=again)) == records(deviate())


@pytest.mark.parametrize(
    "arguments, message",
    [
        ({"scenario_source": "bad"}, "input value of `scenario_source` not found in `data`"),
        ({"scenario": "bad"}, "input value of `scenario` not matched to any sub string.*scenario"),
        ({"bridge_tech": "oilcap"}, "`bridge_tech` must be one of"),
        ({"time_frame": 5.0}, "time_frame must be a single integer"),
        ({"scenario": ["scenario"]}, "scenario must be a single string"),
    ],
)
def test_bad_arguments(deviate, arguments, message):
    with pytest.raises(ValueError, match=message):
        deviate(**arguments)


def test_bad_directions(deviate):
    with pytest.raises(ValueError, match="scenario_source` not found in `technology_direction"):
        deviate(directions=[("other", *DIRECTIONS[0][1:])])
    with pytest.raises(ValueError, match="scenario` not found in `technology_direction"):
        deviate(directions=[("source", "scenarios", *DIRECTIONS[0][2:])])


@pytest.mark.parametrize("validate, error", [(True, ValueError), (False, Exception)])
@pytest.mark.parametrize("absent", ["projected", TARGET])
def test_metric_absent_from_the_window_is_an_error(deviate, absent, validate, error):
    late = [long_row("coalcap", absent, 1.0, year=2040)]
    with pytest.raises(error, match="within the time frame"):
        deviate([r for r in RESULTS if r[6] != absent] + late, validate=validate).collect()


def test_missing_columns(table, spark):
    data = table(RESULTS, schemas.TECHNOLOGY_RESULTS)
    directions = table(DIRECTIONS, schemas.TECHNOLOGY_DIRECTION)
    with pytest.raises(ValueError, match="Must include expected columns(.|\n)*metric, scope"):
        calculate_company_tech_deviation(data.drop("scope", "metric"), directions, **ARGUMENTS)
    with pytest.raises(ValueError, match="directional_dummy"):
        calculate_company_tech_deviation(
            data, directions.drop("directional_dummy"), **ARGUMENTS
        )


def test_year_may_be_a_double(table):
    data = table(RESULTS, schemas.TECHNOLOGY_RESULTS).withColumn("year", F.col("year").cast("double"))
    directions = table(DIRECTIONS, schemas.TECHNOLOGY_DIRECTION)
    assert calculate_company_tech_deviation(data, directions, **ARGUMENTS).count() == 3
