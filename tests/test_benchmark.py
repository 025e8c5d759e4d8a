"""Benchmark loan book, sector codes, activity units and sample inputs."""

import pytest
from pyspark.sql import functions as F

from loanlens import (
    aggregate_alignment_loanbook_exposure,
    build_activity_units,
    create_benchmark_loanbook,
)
from loanlens.operators import activity_units, checks, benchmark
from loanlens.sources import samples, schemas
from tests.conftest import records

CODES = [("power", "3511", False, 1), ("steel", "2410", False, 2)]
REGIONS = [
    ("north america", "us", "source"),
    ("north america", "ca", "source"),
    ("europe", "fr", "source"),
    ("north america", "fr", "other"),
]


def asset(company, sector, production, country="US", year=2022, owner=True, lei=None):
    return (
        company, f"company {company}", lei, owner, sector, "t", country, year,
        production, "MW", None, None, "2022 Q4",
    )


ASSETS = [
    asset(1, "power", 4000.0),
    asset(1, "power", 6000.0),
    asset(1, "steel", 5.0),
    asset(2, "power", 1000.0),
    asset(2, "power", None),
    asset(3, "power", 7000.0, country="FR"),
    asset(4, "power", 7000.0, owner=False),
    asset(5, "power", 7000.0, owner=None),
    asset(6, "power", 7000.0, year=2023),
    asset(7, "coal", 7000.0),
    asset(8, "power", float("nan"), lei="LEI8"),
    asset(None, "power", 1.0, country="CA"),
]


@pytest.fixture
def build(table):
    def run(assets=ASSETS, source="source", year=2022, region="north america", codes=CODES, **arguments):
        return create_benchmark_loanbook(
            table(assets, schemas.ASSET_DATA),
            source,
            year,
            table(REGIONS, schemas.REGION_ISOS),
            region,
            sector_codes=table(codes, schemas.SECTOR_CODES),
            **arguments,
        )

    return run


def test_loanbook(build):
    result = build()
    shown = records(result, "id_loan", "id_direct_loantaker", "id_ultimate_parent", "id_2dii", "sector", "loan_size_outstanding", "sector_classification_direct_loantaker")
    assert shown == [
        ("L1", "CNA", "UPNA", "DLNA", "power", 1.0, "3511"),
        ("L2", "C1", "UP1", "DL1", "power", 10000.0, "3511"),
        ("L3", "C1", "UP1", "DL1", "steel", 5.0, "2410"),
        ("L4", "C2", "UP2", "DL2", "power", 1000.0, "3511"),
        ("L5", "C8", "UP8", "DL8", "power", 0.0, "3511"),
    ]
    assert result.columns[:7] == schemas.column_names(schemas.RAW_LOANS)[1:8]
    assert result.columns[-1] == "id_loan" and len(result.columns) == 29
    row = result.where("id_loan = 'L5'").first()
    assert row["lei_direct_loantaker"] == "LEI8"
    assert row["group_id"] == "benchmark_corporate_economy_north america"
    assert (row["score"], row["borderline"], row["source"]) == (1.0, False, "loanbook")
    assert row["name_abcd"] == row["name"] == row["name_ultimate_parent"] == "company 8"


def test_loanbook_can_be_aggregated(build, table):
    data = table(
        [("company 1", "power", "MW", "r", "s", "x", 2027, "net", 1.0, 0.5),
         ("company 2", "power", "MW", "r", "s", "x", 2027, "net", 1.0, -0.6)],
        schemas.COMPANY_ALIGNMENT,
    )
    row = aggregate_alignment_loanbook_exposure(data, build(), "net", "group_id").aggregate.first()
    assert row["exposure_weighted_net_alignment"] == pytest.approx((0.5 * 10 - 0.6) / 11)


def test_contract(build, table):
    for arguments, message in [
        ({"source": "bad"}, "input value of `scenario_source` not found in `region_isos"),
        ({"region": "asia"}, "input value of `benchmark_region` not found.*europe, north america"),
        ({"source": "other", "region": "europe"}, "input value of `benchmark_region` not found"),
        ({"year": 1999}, "input value of `start_year` not found in `data.year"),
        ({"year": "2022"}, "start_year must be a single integer"),
        ({"region": ["europe"]}, "benchmark_region must be a single string"),
    ]:
        with pytest.raises(ValueError, match=message):
            build(**arguments)
    with pytest.raises(ValueError, match="is_ultimate_owner, lei"):
        create_benchmark_loanbook(
            table(ASSETS, schemas.ASSET_DATA).drop("lei", "is_ultimate_owner"),
            "source",
            2022,
            table(REGIONS, schemas.REGION_ISOS),
            "europe",
            sector_codes=table(CODES, schemas.SECTOR_CODES),
        )


def test_sector_codes(table):
    codes = [
        ("power", "35", False, 1),
        ("power", "3512", False, 3),
        ("power", "3511", False, 4),
        ("power", "3510", False, 5),
        ("power", "35111", True, 2),
        ("power", "35112", None, 2),
        ("coal", "05", False, 6),
        ("steel", None, False, 7),
        ("steel", "2", False, 8),
        ("cement", "23", True, 9),
    ]
    df = table(codes, schemas.SECTOR_CODES)
    expected = [("coal", "05"), ("power", "3512"), ("steel", "2")]
    assert records(benchmark.pick_sector_codes(df)) == expected
    without_order = benchmark.pick_sector_codes(df.drop("ordinal"))
    assert records(without_order) == [("coal", "05"), ("power", "3510"), ("steel", "2")]


def test_activity_units(table):
    rows = [
        (1, "a", None, True, "power", "gascap", "US", 2022, 1.0, "MW", None, None, "q"),
        (2, "b", None, True, "power", "gascap", "US", 2022, 1.0, "MW", 0.1, "tCO2", "q"),
        (3, "c", None, True, "steel", "blast furnace", "US", 2022, 1.0, "t", 0.1, "tCO2/t", "q"),
        (3, "c", None, True, "steel", "blast furnace", "US", 2022, 1.0, "kg", 0.1, "tCO2/t", "q"),
        (4, "d", None, True, "coal", "coal", "US", 2022, 1.0, "t", None, None, "q"),
        (4, "d", None, True, "coal", "coal", "US", 2022, 1.0, "kt", None, None, "q"),
    ]
    units = build_activity_units(table(rows, schemas.ASSET_DATA))
    assert records(units) == [
        ("coal", "coal", "kt"),
        ("coal", "coal", "t"),
        ("power", "gascap", "MW"),
        ("steel", "blast furnace", "tCO2/t"),
    ]
    several = activity_units.technologies_with_several_units(units)
    assert records(several) == [("coal", "coal", 2)]


def test_samples(spark):
    assets, loans = samples.sample_asset_data(spark), samples.sample_loanbook(spark)
    assert assets.columns == schemas.column_names(schemas.ASSET_DATA)
    owners = samples.companies()
    assert assets.select("company_id").distinct().count() == len(owners)
    assert loans.count() == -(-len(owners) // 2)
    built_in = activity_units.default_activity_units(spark).where("sector <> 'hdv'")
    assert records(build_activity_units(assets)) == records(built_in)
    known = assets.select(F.col("name_company").alias("name_direct_loantaker"))
    assert loans.join(known, "name_direct_loantaker", "left_anti").isEmpty()


def test_errors_reach_all_available_values(spark):
    values = spark.range(50).selectExpr("concat('v', lpad(id, 2, '0')) as value").repartition(7)
    errors = [checks.not_found("x", "table", "w", values) for _ in range(2)]
    assert str(errors[0]) == str(errors[1])
    assert "v00, v01" in str(errors[0]) and "(50 in all)" in str(errors[0])
    assert errors[0].available.count() == 50
