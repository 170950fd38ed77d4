import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from skyroll.session import build_session

    ckpt = tempfile.mkdtemp(prefix="skyroll-test-ckpt-")
    s = build_session("local[4]", app_name="skyroll-tests", shuffle_partitions=8, extra={
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": ckpt,
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="skyroll-test-")
