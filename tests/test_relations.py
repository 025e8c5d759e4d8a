"""Joins with missing keys, checked broadcast, group totals and numbering."""

import pytest
from pyspark.sql import functions as F

from loanlens.functions.relations import (
    dimension,
    match,
    with_group_totals,
    with_position,
)
from tests.conftest import records


def test_missing_keys_match_each_other(table):
    left = table([("a", None, 1), (None, "y", 2), ("b", "x", 3)], "k string, j string, v int")
    right = table([("a", None, 10), (None, "y", 20), ("a", "x", 30)], "k string, j string, w int")
    joined = match(left, right, ["k", "j"])
    assert joined.columns == ["k", "j", "v", "w"]
    assert records(joined) == [(None, "y", 2, 20), ("a", None, 1, 10)]
    assert records(match(left, right, ["k", "j"], "left_anti")) == [("b", "x", 3)]
    assert records(match(left, right, ["k", "j"], "left_semi"), "v") == [(1,), (2,)]


def test_names_with_dots(table):
    left = table([("a", 1)], "`k.1` string, v int")
    right = table([("a", 2)], "`k.1` string, `w.2` int")
    assert records(match(left, right, ["k.1"])) == [("a", 1, 2)]


@pytest.mark.parametrize("limit, hinted", [(3, True), (2, False)])
def test_dimension_is_marked_for_broadcast_up_to_a_size(table, limit, hinted):
    df = dimension(table([(i,) for i in range(3)], "i int"), limit)
    assert ("broadcast" in df._jdf.queryExecution().logical().toString()) is hinted
    assert df.count() == 3


def test_group_totals_keep_rows_and_missing_groups(table):
    df = table([("a", 1.0), ("a", 1.0), (None, 5.0), (None, 6.0)], "g string, v double")
    totals = with_group_totals(df, ["g"], F.sum("v").alias("total"))
    assert records(totals) == [(None, 5.0, 11.0), (None, 6.0, 11.0), ("a", 1.0, 2.0), ("a", 1.0, 2.0)]


@pytest.mark.parametrize("size", [0, 1, 100, 3000])
def test_positions_follow_the_order_without_gaps(spark, size):
    # A third of the rows share the leading key.
    df = spark.range(size).selectExpr(
        "if(id % 3 = 0, null, cast(id % 97 as int)) as a", "cast(id as string) as b"
    )
    rows = with_position(df, ["a", "b"], "n").collect()
    expected = sorted(((r["a"], r["b"]) for r in rows), key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
    assert [(r["a"], r["b"]) for r in sorted(rows, key=lambda r: r["n"])] == expected
    assert sorted(r["n"] for r in rows) == list(range(1, size + 1))
