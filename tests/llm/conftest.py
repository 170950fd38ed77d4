import pytest

from llm_cases import EDGE_ROWS, frame


@pytest.fixture(scope="session")
def edge(spark):
    return frame(spark, EDGE_ROWS).cache()


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
