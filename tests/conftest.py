import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from inspectra.session import get_spark
    s = get_spark("local[4]", shuffle_partitions=8,
                  extra={"spark.ui.showConsoleProgress": "false",
                         "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tests-ckpt-", dir="/tmp"),
                         "spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="tests-", dir="/tmp")
