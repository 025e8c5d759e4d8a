import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Build a DataFrame from rows and a schema."""

    def build(rows, schema):
        return spark.createDataFrame(list(rows), schema)

    return build


def records(df, *columns):
    """Rows as sorted tuples of some columns, missing values first."""
    chosen = df.select(*[f"`{c}`" for c in columns]) if columns else df
    return sorted(
        (tuple(r) for r in chosen.collect()),
        key=lambda r: [(v is not None, v) for v in r],
    )
