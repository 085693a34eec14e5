import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from causeway.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    return build_session(
        master="local[8]",
        shuffle_partitions=8,
        extra={
            "spark.checkpoint.dir": f"file://{shared}",
            "spark.driver.memory": "6g",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
