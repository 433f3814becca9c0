import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = os.environ.get("SLUICE_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from sluice.session import session

    s = session("local[4]", "tests", 3, **{"spark.driver.memory": "3g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
