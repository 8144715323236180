import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from shelfgrade.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    yield s
    s.stop()


@pytest.fixture
def one(spark):
    """Value of an expression over one row: ``one({"x": "text"}, lambda: expr)``."""
    def run(row: dict, expr, schema: str | None = None):
        df = spark.createDataFrame([tuple(row.values())], schema or ", ".join(
            f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for k, v in row.items()))
        return df.select(expr.alias("v")).first()["v"]

    return run
