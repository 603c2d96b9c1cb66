"""One session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from histrank.session import clear_shared, get_spark

    s = get_spark("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    clear_shared(s)


def rows(df):
    """The rows of df as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
