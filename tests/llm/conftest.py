import pytest


@pytest.fixture()
def rows(spark):
    """Build a small table from rows and a schema."""
    return lambda data, schema: spark.createDataFrame(data, schema)
