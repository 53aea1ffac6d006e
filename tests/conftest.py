import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tabsmith.session import get_spark
    s = get_spark("local[4]", app="tabsmith-tests", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tabsmith-test-ckpt-")})
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
_MADE: dict = {}


@pytest.fixture(scope="session")
def result(spark):
    """The DataFrame of a registered query, made once a session (a training query fits its model when it is made)."""
    from tabsmith.plans.catalog import load_all
    queries, _ = load_all()

    def made(name):
        if name not in _MADE:
            _MADE[name] = queries[name](spark, SF)
        return _MADE[name]
    return made
