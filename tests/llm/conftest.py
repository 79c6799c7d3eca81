import pytest


@pytest.fixture(scope="session")
def rows(spark):
    """rows(schema, *tuples): a small DataFrame."""
    return lambda schema, *data: spark.createDataFrame(list(data), schema)
