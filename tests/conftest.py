import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers are started from here or find the package by this path
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import session

    base = tmp_path_factory.mktemp("spark")
    s = session(
        os.environ.get("TEST_CPUS", "4"),
        **{
            "spark.sql.shuffle.partitions": "3",
            "spark.sql.warehouse.dir": str(base / "warehouse"),
            "spark.checkpoint.dir": f"file://{base}/shared",
            "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        },
    )
    yield s
    s.stop()
