"""Results stored so that the analyses neither shuffle nor read what they do not need."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a company's technologies in a year, and all sums over them, have in common.
CLUSTERED_BY = ["name_abcd", "sector", "region", "year"]
PARTITIONED_BY = "scenario_source"

PUSHED = {
    # Files read by the newer readers, which take aggregates over.
    "spark.sql.sources.useV1SourceList": "",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def store_clustered(
    results: DataFrame, table: str, buckets: int, path: str | None = None
) -> DataFrame:
    """Results as a table partitioned by source and bucketed by company, sector, region and year.

    Analyses that are told `clustered=True` group it without a shuffle and read one
    source's folder.  A bucket should be about 200 MB.  Each source has a file per bucket.
    """
    writer = (
        results.repartition(buckets, *CLUSTERED_BY)
        .write.mode("overwrite")
        .format("parquet")
        .partitionBy(PARTITIONED_BY)
        .bucketBy(buckets, *CLUSTERED_BY)
    )
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return results.sparkSession.table(table)


@contextmanager
def pushed_aggregates(spark: SparkSession) -> Iterator[None]:
    before = {key: spark.conf.get(key) for key in PUSHED}
    for key, value in PUSHED.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def first_stored_year(spark: SparkSession, path: str) -> int | None:
    """The first year in Parquet files, told by their footers: no row is read.

    To be passed to the analyses as `first_year`; NULL years are left out, and a table
    without years has none.
    """
    with pushed_aggregates(spark):
        return spark.read.parquet(path).agg(F.min("year")).first()[0]
