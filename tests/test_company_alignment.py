"""Company alignment: worked examples, filled directions, emission intensity."""

import pytest
from pyspark.sql import functions as F

from loanlens import (
    calculate_company_aggregate_alignment_sda,
    calculate_company_aggregate_alignment_tms,
)
from loanlens.operators import company_alignment
from loanlens.sources import schemas
from tests.conftest import records

INF = float("inf")

DEVIATIONS = (
    "sector string, technology string, year int, region string, scenario_source string, "
    "name_abcd string, projected double, target_scenario double, direction string, "
    "total_tech_deviation double, activity_unit string"
)
# One company builds too much coal and enough of the rest; another closes coal early.
ROWS = [
    ("power", "coalcap", 2030, "europe", "source", "north", 60.0, 50.0, "phaseout", -10.0, "MW"),
    ("power", "hydrocap", 2030, "europe", "source", "north", 45.0, 30.0, "buildout", 15.0, "MW"),
    ("power", "nuclearcap", 2030, "europe", "source", "north", 20.0, 20.0, "buildout", 0.0, "MW"),
    ("power", "coalcap", 2030, "europe", "source", "south", 10.0, 25.0, "phaseout", 15.0, "MW"),
]
SHOWN = ["name_abcd", "direction", "total_deviation", "alignment_metric"]


@pytest.fixture
def align(table):
    def run(level, rows=ROWS, schema=DEVIATIONS, **arguments):
        return calculate_company_aggregate_alignment_tms(
            table(rows, schema), "source", "scenario", level, **arguments
        )

    return run


def test_net(align):
    result = align("net")
    assert result.columns == company_alignment.OUTPUT
    assert records(result, *SHOWN) == [
        ("north", "net", 5.0, 5 / 100),
        ("south", "net", 15.0, 15 / 25),
    ]


def test_buildout_and_phaseout(align):
    result = align("bo_po")
    assert result.columns == company_alignment.OUTPUT
    assert records(result, *SHOWN) == [
        ("north", "buildout", 15.0, 15 / 100),
        ("north", "phaseout", -10.0, -10 / 100),
        ("south", "buildout", 0.0, 0.0),
        ("south", "phaseout", 15.0, 15 / 25),
    ]


def test_arranged(align):
    rows = [*ROWS, ("coal", "coal", 2027, None, "source", "c3", 1.0, 1.0, "phaseout", 0.0, "t")]
    rows += [("coal", "coal", 2027, "x", "source", "c3", 1.0, 1.0, "phaseout", 0.0, "t")]
    shown = align("net", rows, arranged=True).select("sector", "name_abcd", "region").collect()
    assert [tuple(r) for r in shown] == [
        ("coal", "c3", "x"),
        ("coal", "c3", None),
        ("power", "north", "europe"),
        ("power", "south", "europe"),
    ]


def test_one_direction_in_the_whole_table_is_not_filled(align):
    result = align("bo_po", [r for r in ROWS if r[8] == "phaseout"])
    assert records(result, "name_abcd", "direction") == [("north", "phaseout"), ("south", "phaseout")]


def test_missing_deviations_count_as_zero_and_unknown_direction_is_kept(align):
    rows = [
        ("power", "a", 2027, "r", "source", "c1", None, 10.0, None, None, "MW"),
        ("power", "b", 2027, "r", "source", "c1", 1.0, None, "buildout", None, "MW"),
    ]
    assert records(align("bo_po", rows), *SHOWN) == [
        ("c1", None, 0.0, 0.0),
        ("c1", "buildout", 0.0, 0.0),
    ]


def test_zero_scenario_value(align):
    rows = [
        ("power", "a", 2027, "r", "source", "c1", 1.0, 0.0, "buildout", 2.0, "MW"),
        ("power", "a", 2027, "r", "source", "c2", 1.0, None, "buildout", -2.0, "MW"),
        ("power", "a", 2027, "r", "source", "c3", 1.0, 0.0, "buildout", 0.0, "MW"),
    ]
    assert records(align("net", rows), "name_abcd", "alignment_metric") == [
        ("c1", INF),
        ("c2", -INF),
        ("c3", None),
    ]
    # Completing directions overwrites what is missing.
    assert records(align("bo_po", rows), "name_abcd", "alignment_metric")[2] == ("c3", 0.0)


def test_sources_are_kept_apart_and_not_filtered(align):
    rows = [*ROWS, (*ROWS[3][:4], "other", *ROWS[3][5:])]
    assert align("net", rows).count() == 3


def test_net_value_step(table):
    rows = [
        ("c", "s", "r", "one", t, "u", 2027, v, d, x)
        for t, v, d, x in [("A", 20.0, "buildout", -5.0), ("B", 50.0, "phaseout", 10.0), ("C", 30.0, "phaseout", -10.0)]
    ] + [
        ("c", "s", "r", "two", "X", "u", 2027, 30.0, "buildout", -20.0),
        ("c", "s", "r", "two", "Y", "u", 2027, None, "phaseout", None),
    ]
    schema = (
        "name_abcd string, scenario_source string, region string, sector string, "
        "technology string, activity_unit string, year int, target_scenario double, "
        "direction string, total_tech_deviation double"
    )
    result = company_alignment.beside_scenario_total(table(rows, schema), "target_scenario")
    assert records(result, "technology", "net_absolute_scenario_value") == [
        ("A", 100.0),
        ("B", 100.0),
        ("C", 100.0),
        ("X", 30.0),
        ("Y", 30.0),
    ]
    fused = company_alignment.total_deviation_by_direction(table(rows, schema), "target_scenario")
    assert records(fused, "sector", "direction", "total_deviation") == [
        ("one", "buildout", -5.0),
        ("one", "phaseout", 0.0),
        ("two", "buildout", -20.0),
        ("two", "phaseout", 0.0),
    ]


def test_metric_step(table):
    schema = (
        "name_abcd string, sector string, activity_unit string, region string, "
        "scenario_source string, year int, direction string, total_deviation double, "
        "net_absolute_scenario_value double"
    )
    rows = [
        ("c", "a", "u", "r", "s", 2027, "net", 20.0, 40.0),
        ("c", "b", "u", "r", "s", 2027, "net", 50.0, 40.0),
        ("d", "a", "u", "r", "s", 2027, "net", 30.0, 30.0),
    ]
    result = company_alignment.relative_to_scenario(table(rows, schema), "x")
    assert records(result, "alignment_metric") == [(0.5,), (1.0,), (1.25,)]


def test_fill_keeps_missing_keys_and_repeated_rows(table):
    rows = [
        (None, "power", "MW", "r", "s", "x", 2027, "buildout", -1.0, -0.5),
        (None, "power", "MW", "r", "s", "x", 2027, "buildout", -1.0, -0.5),
        ("c2", "power", "MW", None, "s", "x", 2027, "phaseout", None, float("nan")),
        ("c3", "power", "MW", "r", "s", "x", 2027, None, 1.0, 2.0),
    ]
    result = company_alignment.in_all_directions(table(rows, schemas.COMPANY_ALIGNMENT))
    assert records(result, *SHOWN) == [
        (None, None, 0.0, 0.0),
        (None, "buildout", -1.0, -0.5),
        (None, "buildout", -1.0, -0.5),
        (None, "phaseout", 0.0, 0.0),
        ("c2", None, 0.0, 0.0),
        ("c2", "buildout", 0.0, 0.0),
        ("c2", "phaseout", 0.0, 0.0),
        ("c3", None, 1.0, 2.0),
        ("c3", "buildout", 0.0, 0.0),
        ("c3", "phaseout", 0.0, 0.0),
    ]


def test_tms_contract(align, table):
    with pytest.raises(ValueError, match="input value of `scenario_source` not found"):
        calculate_company_aggregate_alignment_tms(table(ROWS, DEVIATIONS), "bad", "scenario")
    with pytest.raises(ValueError, match="Must include expected columns(.|\n)*target_other"):
        calculate_company_aggregate_alignment_tms(table(ROWS, DEVIATIONS), "source", "other")
    with pytest.raises(ValueError, match="`level` must be one of"):
        align("bo")


# Emission intensity


def sda_row(company, metric, value, year=2027, source="source", sector="steel"):
    return (sector, year, "global", source, company, metric, value)


INTENSITIES = [
    sda_row("A", "projected", 0.8),
    sda_row("A", "target_scenario", 0.7),
    sda_row("B", "projected", 0.55),
    sda_row("B", "target_scenario", 0.6),
]


@pytest.fixture
def align_sda(table):
    def run(rows=INTENSITIES, schema=schemas.INTENSITY_RESULTS, **arguments):
        return calculate_company_aggregate_alignment_sda(
            table(rows, schema), **{"scenario_source": "source", "scenario": "scenario", **arguments}
        )

    return run


@pytest.mark.parametrize("validate", [True, False])
def test_sda(align_sda, validate):
    result = align_sda(validate=validate)
    assert result.columns == company_alignment.OUTPUT
    rows = result.orderBy("name_abcd").collect()
    assert [r["total_deviation"] for r in rows] == pytest.approx([-0.1, 0.05])
    assert [r["alignment_metric"] for r in rows] == pytest.approx([-0.1 / 0.7, 0.05 / 0.6])
    assert {(r["direction"], r["scenario"], r["activity_unit"]) for r in rows} == {
        ("net", "scenario", "tonnes of CO2 per tonne of steel")
    }


def test_sda_leaves_out_market_missing_names_and_late_years(align_sda):
    extra = [
        sda_row("market", "projected", 1.0, year=2026),
        sda_row("market", "target_scenario", 1.0),
        sda_row(None, "projected", 1.0),
        sda_row("C", "projected", 1.0, year=2032),
        sda_row("C", "target_scenario", 1.0, year=2032),
        sda_row("A", "projected", 1.0, source="other"),
    ]
    # The market row of 2026 still starts the window, which then ends in 2031.
    assert records(align_sda([*INTENSITIES, *extra]), *SHOWN) == records(align_sda(), *SHOWN)


def test_sda_without_target(align_sda):
    rows = [
        *INTENSITIES,
        sda_row("C", "projected", 0.5),
        sda_row("D", "projected", 0.5),
        sda_row("D", "target_scenario", 0.0),
        sda_row("E", "target_scenario", 0.5),
    ]
    result = records(align_sda(rows), "name_abcd", "total_deviation", "alignment_metric")
    assert result[2:] == [("C", -0.5, -INF), ("D", -0.5, -INF), ("E", None, None)]


def test_sda_extra_columns_share_the_scenario_total(align_sda):
    schema = schemas.INTENSITY_RESULTS + ", plant string"
    rows = [(*r, "p1") for r in INTENSITIES[:2]] + [(*r, "p2") for r in INTENSITIES[:2]]
    result = align_sda(rows, schema).collect()
    assert [r["total_deviation"] for r in result] == pytest.approx([0.6, 0.6])
    assert [r["alignment_metric"] for r in result] == pytest.approx([0.6 / 1.4] * 2)


def test_sda_sector_with_two_units(align_sda, table):
    units = table([("steel", "a", "u1"), ("steel", "b", "u2"), ("steel", "c", "u2")], schemas.ACTIVITY_UNITS)
    assert records(align_sda(activity_units=units), "name_abcd", "activity_unit") == [
        ("A", "u1"),
        ("A", "u2"),
        ("B", "u1"),
        ("B", "u2"),
    ]


def test_sda_contract(align_sda):
    with pytest.raises(ValueError, match="input value of `scenario_source` not found"):
        align_sda(scenario_source="bad")
    with pytest.raises(ValueError, match="input value of `scenario` not found.*scenario"):
        align_sda(scenario="scen")
    with pytest.raises(ValueError, match="within the time frame"):
        align_sda([r for r in INTENSITIES if r[5] != "projected"])


def test_sda_deviation_step(table):
    df = table([(0.8, 0.7), (1.1, 0.8), (0.6, 0.7)], "projected double, net_absolute_scenario_value double")
    result = company_alignment.with_intensity_gap(df).collect()
    assert [r["total_deviation"] for r in result] == pytest.approx([-0.1, -0.3, 0.1])


def test_directions_of_many_repeated_rows_are_completed_row_by_row(spark):
    """A third of all rows in one unit of analysis: no state or list grows with them."""
    rows = spark.range(90_000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('c', id)) as name_abcd", "'power' as sector",
        "'MW' as activity_unit", "'r' as region", "'s' as scenario_source", "'x' as scenario",
        "2022 as year", "if(id % 2 = 0, 'buildout', 'phaseout') as direction",
        "1D as total_deviation", "cast('nan' as double) as alignment_metric",
    )
    full = company_alignment.in_all_directions(rows)
    plan = full._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan
    assert full.count() == 90_000 + 60_000
    sums = full.groupBy("direction").agg(F.sum("total_deviation"), F.count("alignment_metric"))
    assert records(sums) == [("buildout", 45_000.0, 75_000), ("phaseout", 45_000.0, 75_000)]


def test_an_unheard_of_direction_fails(table):
    row = ("c", "power", "MW", "r", "s", "x", 2022, "sideways", 1.0, 1.0)
    with pytest.raises(Exception, match="neither buildout nor phaseout: sideways"):
        company_alignment.in_all_directions(table([row], schemas.COMPANY_ALIGNMENT)).collect()


def test_places_follow_the_arranged_order_with_missing_values_last(table):
    rows = [
        (name, sector, "MW", "r", "s", "x", year, "net", 1.0, 1.0)
        for name in ("b", None, "a")
        for sector in ("steel", None, "coal")
        for year in (2023, 2022, None)
    ]
    df = table(rows, schemas.COMPANY_ALIGNMENT).repartition(5)
    order = ["sector", "name_abcd", "region", "year"]
    placed = company_alignment.arranged_as(df, order, False, "n")
    sorted_ = company_alignment.arranged_as(df, order, True, None).collect()
    assert [tuple(r[:10]) for r in sorted(placed.collect(), key=lambda r: r["n"])] == [
        tuple(r) for r in sorted_
    ]
    assert sorted(r["n"] for r in placed.collect()) == list(range(1, 28))
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan
    with pytest.raises(ValueError, match="already is a column"):
        company_alignment.arranged_as(df, order, False, "year")
