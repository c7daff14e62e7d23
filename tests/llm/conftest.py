import pytest

from pressline.llm.common import Workspace


@pytest.fixture
def ws(spark):
    return Workspace(spark, "test")
