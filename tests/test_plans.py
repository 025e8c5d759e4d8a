"""Physical plans: what is read, what is shuffled, and that hot keys are split."""

import re

import pytest
from pyspark.sql import functions as F

from loanlens import (
    aggregate_alignment_loanbook_exposure,
    calculate_company_aggregate_alignment_sda,
    calculate_company_aggregate_alignment_tms,
    calculate_company_tech_deviation,
)
from loanlens.functions import relations
from loanlens.functions.relations import match, with_group_totals, with_position
from loanlens.operators import loanbook, tech_deviation
from loanlens.sources import schemas

SPLITTING = {
    "spark.sql.shuffle.partitions": "12",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
}


@pytest.fixture
def splitting(spark):
    """Adaptive execution as on large data: nothing is broadcast, hot partitions are split."""
    before = {key: spark.conf.get(key, None) for key in SPLITTING}
    for key, value in SPLITTING.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def executed(df):
    """The plan as run, without the initial plan it started from."""
    df.collect()
    plan = planned(df)
    return plan.split("== Initial Plan ==")[0]


def hash_exchanges(plan):
    return len(re.findall(r"(?<!, )Exchange hashpartitioning", plan))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Results and directions as tables on disk, in several files."""
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.range(6000).selectExpr(
        "'power' as sector",
        "element_at(array('coalcap', 'gascap', 'renewablescap'), cast(id % 3 + 1 as int)) as technology",
        "cast(2022 + id div 6 % 4 as int) as year",
        "concat('r', id div 24 % 5) as region",
        "'geco_2021' as scenario_source",
        "concat('c', id div 120) as name_abcd",
        "if(id div 3 % 2 = 0, 'projected', 'target_1.5c') as metric",
        "cast(id % 50 as double) as production",
        "0D as technology_share",
        "'sector' as scope",
        "0D as percentage_of_initial_production_by_scope",
    ).repartition(6).write.parquet(f"{folder}/results")
    spark.range(15).selectExpr(
        "'geco_2021' as scenario_source",
        "'1.5c' as scenario",
        "'power' as sector",
        "element_at(array('coalcap', 'gascap', 'renewablescap'), cast(id % 3 + 1 as int)) as technology",
        "concat('r', id div 3) as region",
        "if(id % 3 = 2, 1D, -1D) as directional_dummy",
    ).write.parquet(f"{folder}/directions")
    return folder


@pytest.fixture
def deviations(spark, stored):
    return calculate_company_tech_deviation(
        spark.read.parquet(f"{stored}/results"),
        spark.read.parquet(f"{stored}/directions"),
        validate=False,
    )


def test_filters_and_columns_reach_the_scan(spark, deviations):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = planned(deviations)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "production" in line)
    assert "EqualTo(scenario_source,geco_2021)" in scan
    assert "In(metric, [projected,target_1.5c])" in scan
    assert "technology_share" not in scan and "scope" not in scan


def test_deviations_and_net_alignment_shuffle_once(deviations):
    assert hash_exchanges(planned(deviations)) == 1
    net = calculate_company_aggregate_alignment_tms(deviations, validate=False)
    assert hash_exchanges(planned(net)) == 1


def test_counted_lookups_are_broadcast_whatever_their_estimate(spark, splitting, stored):
    def plan():
        return planned(
            calculate_company_tech_deviation(
                spark.read.parquet(f"{stored}/results"),
                spark.read.parquet(f"{stored}/directions"),
                activity_units=spark.createDataFrame(
                    [("power", "gascap", "MW")], schemas.ACTIVITY_UNITS
                ),
                validate=False,
            )
        )

    assert plan().count("BroadcastHashJoin") == 2
    assert "SortMergeJoin" not in plan()


def test_long_lookups_are_joined_by_shuffle(spark, splitting, stored, monkeypatch):
    monkeypatch.setattr(tech_deviation, "BROADCAST_ROWS", 3)
    deviations = calculate_company_tech_deviation(
        spark.read.parquet(f"{stored}/results"),
        spark.read.parquet(f"{stored}/directions"),
        validate=False,
    )
    plan = planned(deviations)
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 1
    monkeypatch.undo()
    assert sorted(deviations.collect()) == sorted(
        calculate_company_tech_deviation(
            spark.read.parquet(f"{stored}/results"), spark.read.parquet(f"{stored}/directions")
        ).collect()
    )


def test_directions_are_completed_from_the_same_shuffle(deviations):
    split = calculate_company_aggregate_alignment_tms(deviations, level="bo_po", validate=False)
    plan = executed(split)
    assert "ReusedExchange" in planned(split)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_intensity_alignment_shuffles_once(spark, tmp_path):
    rows = spark.range(100).selectExpr(
        "'steel' as sector", "2022 as year", "'r' as region", "'geco_2021' as scenario_source",
        "concat('c', id div 2) as name_abcd",
        "if(id % 2 = 0, 'projected', 'target_1.5c') as emission_factor_metric",
        "cast(id as double) as emission_factor_value",
    )
    rows.write.parquet(str(tmp_path / "sda"))
    stored = spark.read.parquet(str(tmp_path / "sda"))
    assert hash_exchanges(planned(calculate_company_aggregate_alignment_sda(stored, validate=False))) == 1


@pytest.fixture(scope="module")
def hot_loans(spark, tmp_path_factory):
    """Loans of many books to many companies; one company, and one book, has a third."""
    folder = str(tmp_path_factory.mktemp("hot") / "loans")
    spark.range(30000).selectExpr(
        "concat('L', id) as id_loan",
        "cast(id % 100 as double) as loan_size_outstanding",
        "'USD' as loan_size_outstanding_currency",
        "if(id % 3 = 0, 'hot', concat('c', id % 700)) as name_abcd",
        "'power' as sector",
        "sha2(cast(id as string), 256) as book",
        "if(id % 3 = 1, 'hot', concat('b', id % 700)) as bank",
        "sha2(cast(id as string), 256) as borrower",
    ).repartition(8).write.parquet(folder)
    return spark.read.parquet(folder)


@pytest.fixture
def company_alignment(spark):
    return spark.range(701).selectExpr(
        "if(id = 700, 'hot', concat('c', id)) as name_abcd", "'power' as sector",
        "'MW' as activity_unit", "'r' as region", "'s' as scenario_source", "'x' as scenario",
        "2022 as year", "'net' as direction", "1D as total_deviation", "0.5D as alignment_metric",
    )


def test_a_hot_company_is_split(splitting, hot_loans, company_alignment):
    result = aggregate_alignment_loanbook_exposure(
        company_alignment, hot_loans, "net", ["book"]
    ).aggregate
    plan = executed(result)
    assert "SortMergeJoin(skew=true)" in plan
    assert result.count() == 30000


def test_a_hot_company_is_split_among_keys_that_cannot_be_missing(
    splitting, spark, hot_loans, company_alignment
):
    named = hot_loans.na.fill("", ["name_abcd", "sector", "book", "loan_size_outstanding_currency"])
    assert not named.schema["name_abcd"].nullable
    plan = executed(
        aggregate_alignment_loanbook_exposure(company_alignment, named, "net", ["book"]).aggregate
    )
    assert "SortMergeJoin(skew=true)" in plan


def test_small_book_totals_are_broadcast(splitting, hot_loans):
    """No exposure is shuffled by its currency."""
    weighed = loanbook.add_exposure_weight(loanbook.loan_exposure(hot_loans))
    assert "BroadcastHashJoin" in executed(weighed)
    assert "SortMergeJoin" not in executed(weighed)


@pytest.fixture
def counting(spark):
    """Marks rows so that each is counted whenever it is computed."""
    counter = spark.sparkContext.accumulator(0)

    def mark(df, column):
        @F.udf("string")
        def seen(value):
            counter.add(1)
            return value

        return df.withColumn(column, seen(column))

    return mark, counter


def test_weights_start_no_job_and_read_the_loans_once(spark, hot_loans, counting):
    mark, counter = counting
    hot_loans = mark(hot_loans, "sector")
    tracker = spark.sparkContext.statusTracker()
    group = "building weights"
    spark.sparkContext.setJobGroup(group, group)
    try:
        weighed = loanbook.add_exposure_weight(loanbook.loan_exposure(hot_loans, ["bank"]), ["bank"])
        assert list(tracker.getJobIdsForGroup(group)) == []
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert weighed.count() > 1000
    weighed.collect()
    assert counter.value == 2 * 30_000  # a count and a collection


def test_deviations_of_stored_tables_start_no_job(spark, stored):
    results = spark.read.parquet(f"{stored}/results")
    directions = spark.read.parquet(f"{stored}/directions")
    group = "building deviations"
    spark.sparkContext.setJobGroup(group, group)
    try:
        calculate_company_tech_deviation(results, directions, validate=False)
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == []
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_a_lookup_larger_than_its_estimate_fails_when_the_plan_runs(spark):
    # An estimate does not count what explode adds.
    wide = spark.range(1).selectExpr("explode(sequence(1, 50)) as k")
    marked = relations.dimension(wide, 20)
    assert "broadcast" in marked._jdf.queryExecution().logical().toString()
    with pytest.raises(Exception, match="more than 20 rows"):
        marked.collect()


def test_positions_compute_the_rows_once(spark, stored, counting):
    mark, counter = counting
    rows = mark(spark.read.parquet(f"{stored}/results"), "name_abcd")
    sums = rows.groupBy("name_abcd", "year").agg(F.sum("production").alias("p"))
    numbered = with_position(sums, ["name_abcd", "year"], "n").collect()
    assert [r["n"] for r in sorted(numbered)] == list(range(1, 201))
    assert counter.value == 6000


def test_a_hot_book_is_split(splitting, hot_loans, monkeypatch):
    monkeypatch.setattr(relations, "BROADCAST_ROWS", 0)
    loans = hot_loans.drop("name_abcd").withColumnRenamed("borrower", "name_abcd")
    weighed = loanbook.add_exposure_weight(loanbook.loan_exposure(loans, ["bank"]), ["bank"])
    assert "SortMergeJoin(skew=true)" in executed(weighed)
    books = weighed.groupBy("bank").agg(F.sum("exposure_weight").alias("w"))
    assert books.where("bank = 'hot'").first()["w"] == pytest.approx(1.0)


def test_a_hot_group_is_split_among_keys_that_cannot_be_missing(splitting, spark):
    rows = spark.range(40000).selectExpr(
        "if(id % 3 = 0, 0, id) as k", "sha2(cast(id as string), 256) as v"
    )
    assert not rows.schema["k"].nullable
    totals = with_group_totals(rows.repartition(8), ["k"], F.count("*").alias("n"))
    assert "SortMergeJoin(skew=true)" in executed(totals)
    assert totals.where("k = 0").agg(F.min("n"), F.count("*")).first()[:] == (13334, 13334)


def test_rows_identified_by_extra_columns_are_split(splitting, spark):
    """One company, region and year with a third of the rows, told apart by plant."""
    wide = spark.range(40000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('c', id)) as name_abcd", "'r' as region",
        "'s' as scenario_source", "'power' as sector", "2022 as year", "'gascap' as technology",
        "sha2(cast(id as string), 256) as plant", "0D as projected", "if(id % 3 = 0 and id <> 0, 0D, 1D) as target_x",
    ).repartition(8)
    active = tech_deviation.without_idle_technologies(wide, "target_x")
    kept = tech_deviation.without_untargeted_sectors(active, "target_x")
    assert "SortMergeJoin(skew=true)" in executed(kept)
    # The hot company has one plant with a target, which keeps all of its plants.
    assert kept.count() == 40000


def test_no_join_is_a_nested_loop(spark, stored, deviations, hot_loans):
    split = calculate_company_aggregate_alignment_tms(deviations, level="bo_po", validate=False)
    result = aggregate_alignment_loanbook_exposure(split, hot_loans, "bo_po", "book")
    for df in result:
        assert "NestedLoop" not in planned(df) and "Cartesian" not in planned(df)


def test_missing_keys_still_join_by_hash_or_sort(spark):
    left = spark.range(10).selectExpr("cast(id as string) as k", "id as v")
    right = spark.range(10).selectExpr("cast(id as string) as k", "id as w")
    assert re.search("BroadcastHashJoin|SortMergeJoin", planned(match(left, right, ["k"])))


def test_schemas_name_the_columns_checked():
    assert schemas.column_names(schemas.REGION_ISOS) == ["region", "isos", "source"]
