import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A data frame from rows and a schema, in several partitions."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema).repartition(3)

    return make
