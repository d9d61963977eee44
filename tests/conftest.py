import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from bazaar.session import get_session

    from tools.executed_plans import event_log

    folder = tempfile.mkdtemp(prefix="bazaar-tests-")
    os.mkdir(f"{folder}/events")
    s = get_session("local[4]", app_name="bazaar-tests", shuffle_partitions=8,
                    extra=event_log(f"{folder}/events") | {
                        "spark.checkpoint.dir": f"file://{folder}/checkpoints",
                        "spark.sql.warehouse.dir": f"{folder}/warehouse"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def events(spark):
    """The folder of the session's event log."""
    return spark.conf.get("spark.eventLog.dir").removeprefix("file://")
