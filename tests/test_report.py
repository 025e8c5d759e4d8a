"""Checks of all inputs as rows."""

import pytest
from pyspark.sql import functions as F

from loanlens.operators.report import ValueCheck, offered_values
from tests.conftest import records


def check(wanted, column="v"):
    value = F.col(column)
    return ValueCheck(f"is {wanted}", column, wanted, value, value == wanted)


def test_a_row_per_value_and_one_where_there_is_none(table):
    df = table([("a", 1), ("b", None), ("a", None), (None, None)], "v string, w int")
    found = offered_values(df, "t", [check("a"), check("c"), check(7, "w")])
    assert records(found) == [
        ("t", "is 7", "w", "7", "1", False),
        ("t", "is a", "v", "a", "a", True),
        ("t", "is a", "v", "a", "b", True),
        ("t", "is c", "v", "c", "a", False),
        ("t", "is c", "v", "c", "b", False),
    ]
    empty = offered_values(df.limit(0), "t", [check("a"), check(7, "w")])
    assert records(empty) == [
        ("t", "is 7", "w", "7", None, False),
        ("t", "is a", "v", "a", None, False),
    ]


def test_many_values_are_all_told_from_one_pass(spark, tmp_path):
    spark.range(5000).selectExpr("concat('v', id) as v", "id as w").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    found = offered_values(df, "t", [check("v77"), check(-1, "w")])
    rows = found.collect()
    assert len(rows) == 10_000
    assert {(r["check"], r["ok"]) for r in rows} == {("is v77", True), ("is -1", False)}
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1
    assert "collect_set" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("value", ["it's", 'a "quoted" value', "back\\slash"])
def test_requested_values_are_told_as_they_are(table, value):
    found = offered_values(table([("a",)], "v string"), "t", [check(value)])
    assert records(found, "requested", "ok") == [(value, False)]
