"""Arithmetic with missing values."""

import math

import pytest
from pyspark.sql import functions as F

from loanlens.functions.missing import (
    known,
    known_total,
    ratio,
    text_or_na,
)

NAN, INF = float("nan"), float("inf")


def value(df, column):
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "values, expected",
    [([], 0.0), ([None, None], 0.0), ([1.0, None, NAN], 1.0), ([INF, 1.0], INF)],
)
def test_known_total(table, values, expected):
    df = table([(v,) for v in values], "x double")
    assert df.agg(known_total(F.col("x"))).first()[0] == expected


@pytest.mark.parametrize(
    "n, d, expected",
    [
        (6.0, 3.0, 2.0),
        (1.0, 0.0, INF),
        (-1.0, 0.0, -INF),
        (0.0, 0.0, None),
        (NAN, 0.0, None),
        (NAN, 2.0, None),
        (None, 2.0, None),
        (2.0, None, None),
        (None, 0.0, None),
        (INF, INF, None),
        (2.0, NAN, None),
        (-3.0, INF, 0.0),
    ],
)
def test_ratio(table, n, d, expected):
    df = table([(n, d)], "n double, d double")
    assert value(df, ratio(F.col("n"), F.col("d"))) == expected


def test_known(table):
    df = table([(1.5,), (NAN,), (None,)], "x double")
    assert [r[0] for r in df.select(known(F.col("x"))).collect()] == [1.5, None, None]
    assert not any(
        isinstance(r[0], float) and math.isnan(r[0])
        for r in df.select(known(F.col("x"))).collect()
    )


def test_text_or_na(table):
    df = table([(7,), (None,)], "i int")
    assert [r[0] for r in df.select(text_or_na(F.col("i"))).collect()] == ["7", "NA"]
