import os
import sys
import tempfile

import pytest
from sf_dirs import SF_CHECK

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def event_folder():
    """Where the session's event log goes, which the plan tests read."""
    return tempfile.mkdtemp(prefix="aislewise-events-")


@pytest.fixture(scope="session")
def spark(event_folder):
    from aislewise.session import checkpoint_dir, local_session
    from tools.executed_plans import ExecutedPlans

    s = local_session(cores="*", shuffle_partitions=8, app="aislewise-tests", conf=ExecutedPlans.conf(event_folder))
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from aislewise.sources.tables import derive_from_driver_tables

    return derive_from_driver_tables(spark, SF_CHECK)
