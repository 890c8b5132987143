import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tonescope.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", "local[8]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Rows of a small feedback table: (industry, org, aspect, sentiment[, source])."""
    def build(rows):
        full = [(f"R{i}", *r[:2], "P", *r[2:4], r[4] if len(r) > 4 else "O")
                for i, r in enumerate(rows)]
        return spark.createDataFrame(
            full, "review_id string, industry string, org string, parent_aspect string, "
                  "aspect string, sentiment string, source string")
    return build
