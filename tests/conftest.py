import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
os.environ.setdefault("PYSPARK_DRIVER_PYTHON", sys.executable)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sparkloom.session import local_session

    session = local_session(cores=4, partitions=4, name="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
