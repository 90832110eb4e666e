import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from carsift.session import local_session

    s = local_session(8, "tests", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield s
    s.stop()
