import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fixtures import ODD, write_tables  # noqa: E402


@pytest.fixture(scope="session")
def odd_dir(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("odd"), ODD, clashing=False)


@pytest.fixture(scope="session")
def clashing_dir(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("clashing"), ODD, clashing=True)


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("empty"), [], clashing=True)
