import pytest

from occuspan.session import builder


@pytest.fixture(scope="session")
def spark():
    s = builder("local[4]", partitions=4, memory="4g").config("spark.sql.adaptive.coalescePartitions.enabled", "true").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF
