import pytest

from lakeaudit.llm.pieces import default_path


@pytest.fixture(scope="session")
def path():
    return default_path()
