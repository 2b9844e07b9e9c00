import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from varve.session import build_session  # noqa: E402
from varve.sources.tables import Settings  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "varve tests",
        master="local[8]",
        extra={
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


_ENVS = iter(range(10_000))


@pytest.fixture
def settings(tmp_path):
    """A fresh environment: own databases, own directories."""
    return Settings(root=str(tmp_path), env=f"t{next(_ENVS)}")


@pytest.fixture(scope="session")
def rows():
    """Collected rows as a sorted list of tuples."""

    def collect(df, *cols):
        picked = df.select(*cols) if cols else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)

    return collect
