import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A table from rows and a schema."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make
