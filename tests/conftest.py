import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from codeloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]",
        "codeloom-tests",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    """Sources from path=text, all at revision 1."""

    def make(**texts):
        return spark.createDataFrame([(1, p, t) for p, t in texts.items()], "rev bigint, path string, content string")

    return make


@pytest.fixture
def pairs(spark):
    """Pairs from path=(old, new), all at revision 1."""

    def make(**texts):
        rows = [(p, 1, old, new) for p, (old, new) in texts.items()]
        return spark.createDataFrame(rows, "path string, rev bigint, old_content string, new_content string")

    return make
