"""Joins in which a missing key matches a missing key, and group totals.

Skew.  A hot key is split by adaptive execution, from the sizes it measured and on
either side of a join, provided that each side is shuffled just for that join and
nothing before or after counts on its partitioning.  `split_hot_keys` sees to that.
Group totals beside rows are therefore aggregated (combined map-side first) and joined
back instead of being windows, which would gather a group in one task.  Windows are
used only over groups whose size is bounded by what they contain.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.functions.missing import field

# Rows up to which a dimension is broadcast; a few megabytes of short columns.
BROADCAST_ROWS = 100_000

# Bytes that a row of a lookup table takes at least in an estimate of its size: few, as files
# are compressed.
LOOKUP_ROW_BYTES = 4


def match(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    split_hot_keys: bool = False,
) -> DataFrame:
    """Join on `keys`, NULL matching NULL; the key columns appear once, from the left.

    `split_hot_keys` makes a hash of the keys one more key, which no grouping or other
    join is partitioned by.  For sides that may be large.
    """
    renamed = right.select(
        *[field(k).alias(f"_match_{k}") for k in keys],
        *[field(c) for c in right.columns if c not in keys],
    )
    pairs = [(field(k), field(f"_match_{k}")) for k in keys]
    condition = reduce(lambda a, b: a & b, [a.eqNullSafe(b) for a, b in pairs])
    if split_hot_keys:
        left_hash, right_hash = (F.xxhash64(*side) for side in zip(*pairs, strict=True))
        condition = condition & (left_hash == right_hash)
    return left.join(renamed, condition, how).drop(*[f"_match_{k}" for k in keys])


def estimated_bytes(df: DataFrame) -> int:
    """Size by the optimizer's estimate, which for stored tables is that of their files."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def at_most(df: DataFrame, rows: int) -> DataFrame:
    """The rows; fails, when the plan runs, if there are more."""
    message = f"a lookup table that was estimated small has more than {rows} rows"
    within = F.when(F.count("*") > rows, F.raise_error(F.lit(message)).cast("boolean"))
    return df.where(df.limit(rows + 1).agg(within.otherwise(True)).scalar())


def dimension(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a lookup table for broadcast if it is small.

    One that is small by its estimate is checked when the plan runs, and costs no job
    before.  Others are counted, up to the bound.  A larger one comes back unmarked and
    is joined by shuffle.
    """
    if estimated_bytes(df) <= max_rows * LOOKUP_ROW_BYTES:
        return F.broadcast(at_most(df, max_rows))
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def values_differ(value: Column) -> Column:
    """Aggregate: whether a group has two values, of which NULL may be one."""
    n_known = F.count(value)
    some_missing = (n_known > 0) & (n_known < F.count("*"))
    return F.coalesce(F.min(value) != F.max(value), F.lit(False)) | some_missing


def one_value(value: Column, message: str) -> Column:
    """Aggregate: the value that all rows of a group have; fails if they differ."""
    return F.when(values_differ(value), F.raise_error(F.lit(message))).otherwise(F.max(value))


def lookup_of(
    df: DataFrame, keys: Sequence[str], value: str, message: str, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """`keys` and the one `value` of each, to be joined; the plan fails on two values.

    A table that is small by its estimate is read by one task, without a shuffle, and
    marked for broadcast; see `dimension`.
    """
    small = estimated_bytes(df) <= max_rows * LOOKUP_ROW_BYTES
    rows = df.coalesce(1) if small else df
    single = rows.groupBy(*[field(k) for k in keys]).agg(
        one_value(field(value), message).alias(value)
    )
    return dimension(single, max_rows)


def looked_up(left: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join with a lookup whose size is only known when the plan runs.

    The plan holds both ways: a broadcast of no more rows than the bound, and a join by
    shuffle that splits hot keys.  A count of the lookup, a scalar subquery, turns one of
    them off before its rows move.  `left` should end in a shuffle, which both ways and
    the lookup can share; else it is computed once for each.
    """
    few = lookup.agg(F.count("*") <= BROADCAST_ROWS).scalar()
    small = match(left.where(few), F.broadcast(lookup.where(few)), keys)
    large = match(left.where(~few), lookup.where(~few), keys, split_hot_keys=True)
    return small.union(large)


def with_group_totals(df: DataFrame, keys: Sequence[str], *totals: Column) -> DataFrame:
    """Every row of `df` with the aggregates of its group beside it."""
    sums = df.groupBy(*[field(k) for k in keys]).agg(*totals)
    return match(df, sums, keys, split_hot_keys=True)


def with_position(
    df: DataFrame, order: Sequence[str], name: str, nulls_first: bool = True
) -> DataFrame:
    """Number the rows 1..n along `order` on many tasks.

    One exchange deals the rows to ranges of the order and sorts them there.  A row's
    number is its place in its range plus the rows of earlier ranges, of which there are
    as many as shuffle partitions.  Counts and rows read the same exchange, so `df` is
    computed once; if it ends in a shuffle, so is the sample that the ranges are cut by.
    `order` should identify a row: rows that tie on it are in one range, in any order.
    """
    keys = [
        field(c).asc_nulls_first() if nulls_first else field(c).asc_nulls_last() for c in order
    ]
    # A fixed number of ranges, which adaptive execution leaves as they are.
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *keys)
    # True of every row, but told from all columns: without some of them the counts would
    # get an exchange, and a computation of `df`, of their own.
    every = F.xxhash64(*[field(c) for c in df.columns]) >= F.lit(-(1 << 63))
    sizes = dealt.groupBy(F.spark_partition_id().alias("_range")).agg(
        F.count_if(every).alias("_size")
    )
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset")
    )
    # The id holds the partition above 33 bits and the row's place within it below.
    placed = dealt.sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    place = F.col("_id").bitwiseAND((1 << 33) - 1)
    return (
        placed.withColumn("_range", F.shiftright("_id", 33).cast("int"))
        .join(F.broadcast(offsets), "_range")
        .withColumn(name, place + F.col("_offset") + 1)
        .drop("_range", "_id", "_offset")
    )
