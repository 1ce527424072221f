import pytest


@pytest.fixture(scope="session")
def docs(spark):
    from corpus import SCHEMA, documents

    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()
