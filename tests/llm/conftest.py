import pytest
from odd_docs import ODD, SCHEMA


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3, "n_chars").cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    def table(rows, schema=SCHEMA):
        return spark.createDataFrame(rows, schema)

    return table
