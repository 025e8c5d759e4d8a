"""Stored results: no shuffle before the sums, one source's folder, the first year from footers."""

import re

import pytest
from pyspark.sql import functions as F

from loanlens import (
    calculate_company_aggregate_alignment_sda,
    calculate_company_aggregate_alignment_tms,
    calculate_company_tech_deviation,
)
from loanlens.sources.storage import first_stored_year, pushed_aggregates, store_clustered
from tests.conftest import records
from tests.test_plans import planned, stored  # noqa: F401

ARGUMENTS = {"validate": False}


@pytest.fixture
def results(spark, stored):  # noqa: F811
    one = spark.read.parquet(f"{stored}/results")
    return one.unionByName(one.withColumn("scenario_source", F.lit("weo_2021")))


@pytest.fixture
def directions(spark, stored):  # noqa: F811
    return spark.read.parquet(f"{stored}/directions")


@pytest.fixture
def clustered(spark, results, tmp_path):
    yield store_clustered(results, "clustered_results", 4, str(tmp_path / "clustered"))
    spark.sql("drop table clustered_results")


@pytest.mark.parametrize("level", ["net", "bo_po"])
def test_sums_of_a_stored_table_take_no_shuffle(spark, results, directions, clustered, level):
    def alignment(data, **options):
        deviations = calculate_company_tech_deviation(data, directions, **ARGUMENTS, **options)
        return calculate_company_aggregate_alignment_tms(deviations, level=level, validate=False)

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    stored_ones = alignment(clustered, clustered=True)
    stored_ones.collect()
    plan = planned(stored_ones)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "Exchange hashpartitioning" not in plan
    # Only the folder of the source that was asked for is read.
    scans = re.findall(r"FileScan .*ReadSchema: .*production", plan)
    assert scans and all(
        re.search(r"PartitionFilters: [^]]*scenario_source#\d+ = geco_2021", s) for s in scans
    )
    assert records(stored_ones) == records(alignment(results))


def test_a_stored_table_has_a_file_per_bucket_and_source(clustered):
    files = clustered.inputFiles()
    assert len(files) == 8
    assert {f.split("scenario_source=")[1].split("/")[0] for f in files} == {
        "geco_2021",
        "weo_2021",
    }


def test_the_first_year_comes_from_the_footers(spark, results, tmp_path):
    path = str(tmp_path / "t")
    results.write.parquet(path)
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    with pushed_aggregates(spark):
        first = spark.read.parquet(path).agg(F.min("year"))
        plan = first._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MIN(year)]" in plan
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    assert first_stored_year(spark, path) == 2022
    results.limit(0).write.parquet(str(tmp_path / "empty"))
    assert first_stored_year(spark, str(tmp_path / "empty")) is None


def test_a_known_first_year_changes_nothing(results, directions):
    def deviations(**options):
        return calculate_company_tech_deviation(results, directions, **ARGUMENTS, **options)

    assert records(deviations(first_year=2022)) == records(deviations())
    assert deviations(first_year=2023).agg(F.min("year")).first()[0] == 2023
    with pytest.raises(Exception, match="no projected values"):
        deviations(first_year=1990).collect()
    with pytest.raises(Exception, match="no target values"):
        calculate_company_tech_deviation(
            results.where("metric = 'projected'"), directions, **ARGUMENTS, first_year=2022
        ).collect()


def test_a_known_first_year_of_intensities(spark):
    rows = spark.range(40).selectExpr(
        "'steel' as sector", "cast(2022 + id % 4 as int) as year", "'r' as region",
        "'geco_2021' as scenario_source", "concat('c', id div 8) as name_abcd",
        "if(id div 4 % 2 = 0, 'projected', 'target_1.5c') as emission_factor_metric",
        "cast(id as double) as emission_factor_value",
    )
    plain = calculate_company_aggregate_alignment_sda(rows, validate=False)
    told = calculate_company_aggregate_alignment_sda(rows, validate=False, first_year=2022)
    assert records(told) == records(plain) and plain.count() == 20
    with pytest.raises(Exception, match="no projected values"):
        calculate_company_aggregate_alignment_sda(rows, validate=False, first_year=1990).collect()
