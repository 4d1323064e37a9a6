import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

from nodeloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = local_session(8, 4, **{"spark.checkpoint.dir": str(folder), "spark.sql.warehouse.dir": str(folder / "warehouse")})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Small tables from plain rows."""

    class Make:
        @staticmethod
        def edges(pairs):
            return spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "src bigint, dst bigint")

        @staticmethod
        def nodes(ids):
            return spark.createDataFrame([(int(i),) for i in ids], "node_id bigint")

        @staticmethod
        def table(rows, schema):
            return spark.createDataFrame(rows, schema)

    return Make


def rows(df, *cols):
    """Sorted tuples of the chosen columns."""
    cols = cols or df.columns
    return sorted(tuple(r) for r in df.select(*cols).collect())


def hub_graph(n=120, seed=0):
    """Random pairs plus a hub: node 0 is an end of about a third of all edges on each side."""
    import random

    rng = random.Random(seed)
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(n)}
    pairs |= {(0, i) for i in range(1, n, 2)} | {(i, 0) for i in range(1, n, 2)}
    return sorted((a, b) for a, b in pairs if a != b)
