import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MED = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from qforge.session import get_session
    # the session's own spark.checkpoint.dir is used; configure() sets a
    # temporary one only when none is configured
    s = get_session("local[4]", app_name="qforge-tests", shuffle_partitions=8,
                    extra_conf={"spark.driver.memory": "4g"})
    yield s
    s.stop()
