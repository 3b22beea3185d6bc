import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def frame(spark):
    """A DataFrame of rows under a DDL schema, over a few partitions."""

    def make(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make
