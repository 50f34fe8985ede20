import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers import the test modules; the package itself travels with its tasks.
os.environ["PYTHONPATH"] = os.pathsep.join(
    filter(None, [os.path.dirname(__file__), os.environ.get("PYTHONPATH")])
)

from veritally.plans.shared import tuned_builder  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        tuned_builder(cores=8)
        .master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Rows to a DataFrame by a DDL schema."""

    def make(schema, data):
        return spark.createDataFrame([tuple(r) for r in data], schema)

    return make
