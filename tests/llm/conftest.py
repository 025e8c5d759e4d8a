from tests.conftest import spark, table  # noqa: F401
