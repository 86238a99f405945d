import pytest

from tidemark.session import get_spark


@pytest.fixture(scope="session")
def spark():
    return get_spark("tests", cpus=4, partitions=4)
