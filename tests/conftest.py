import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    from tallygrove.session import get_spark

    session = get_spark(int(os.environ.get("TEST_CPUS", "8")), "tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def smoke_dir():
    found = "/root/testdata/sf0.001"
    if not Path(found).exists():
        pytest.skip("no test tables here")
    return found
