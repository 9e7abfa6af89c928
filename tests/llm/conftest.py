import pytest

from .fixtures import SCHEMA, awkward


@pytest.fixture
def odd(spark):
    """The awkward documents in several partitions."""
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
