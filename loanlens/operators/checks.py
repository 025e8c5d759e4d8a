"""Input contracts: required columns, and values an argument must be found among.

The column check costs no job.  A value check reads the one column concerned and
stops at the first match; where the first year has to be found anyway, the checks of
an input share that pass.  The values on offer are only looked up to word an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.functions.missing import field

# Values spelt out in an error message; the error carries all of them.
QUOTED_VALUES = 20


class ValueNotFound(ValueError):
    """A value that is not in its table. `available` is a DataFrame of all that are."""

    def __init__(self, message: str, available: DataFrame):
        super().__init__(message)
        self.available = available


def missing_columns(df: DataFrame, expected: Iterable[str]) -> list[str]:
    return sorted(set(expected) - set(df.columns))


def validate_data_has_expected_cols(data: DataFrame, expected_columns: Iterable[str]) -> None:
    """Raise ValueError unless `data` has all the columns; others are allowed."""
    absent = missing_columns(data, expected_columns)
    if absent:
        raise ValueError(
            "Must include expected columns in input data set.\n"
            f"Missing columns: {', '.join(absent)}.\n"
            "Please check that data has expected columns."
        )


def one_of(argument: str, value: str, choices: Sequence[str]) -> None:
    if value not in choices:
        raise ValueError(f"`{argument}` must be one of {', '.join(choices)}, not {value!r}.")


def one_text(argument: str, value: object) -> None:
    if not isinstance(value, str):
        raise ValueError(f"Argument {argument} must be a single string.")


def one_integer(argument: str, value: object) -> None:
    if isinstance(value, bool) or not isinstance(value, int):
        raise ValueError(f"Argument {argument} must be a single integer.")


def occurs(df: DataFrame, condition: Column) -> bool:
    """Whether any row meets the condition; reads no further than the first that does."""
    return not df.where(condition).isEmpty()


def found(condition: Column) -> Column:
    """Aggregate: whether any row meets the condition."""
    return F.coalesce(F.bool_or(condition), F.lit(False))


def flags(df: DataFrame, **aggregates: Column):
    """Evaluate the aggregates in one job and return the row."""
    return df.agg(*[column.alias(name) for name, column in aggregates.items()]).first()


def quoted(values: DataFrame) -> str:
    """Distinct values of a one-column frame in order: the first ones, and how many there are."""
    distinct = values.distinct()
    column = field(values.columns[0])
    rows = distinct.orderBy(column.asc_nulls_first()).limit(QUOTED_VALUES + 1).collect()
    texts = ["NA" if r[0] is None else str(r[0]) for r in rows]
    if len(texts) <= QUOTED_VALUES:
        return ", ".join(sorted(texts))
    return f"{', '.join(texts[:QUOTED_VALUES])}, ... ({distinct.count()} in all)"


def not_found(argument: str, place: str, value: object, values: DataFrame) -> ValueNotFound:
    return ValueNotFound(
        f"input value of `{argument}` not found in `{place}`. You provided {value}. "
        f"Available values are: {quoted(values)}",
        values.distinct(),
    )


def scenarios_on_offer(metrics: DataFrame, column: str) -> DataFrame:
    """Scenario names in a metric column: the target metrics without their prefix."""
    return metrics.where(F.contains(field(column), F.lit("target_"))).select(
        F.replace(field(column), F.lit("target_"), F.lit("")).alias("scenario")
    )
