import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from freshstream.session import build_session
    s = build_session("local[4]", shuffle_partitions=8, app_name="freshstream-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="fs-test-"),
                             "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="fs-wh-")})
    yield s
    s.stop()


@pytest.fixture()
def workdir(spark):
    from freshstream.session import work_root
    return tempfile.mkdtemp(prefix="case-", dir=work_root(spark))
