import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import SF_CHECK  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from cartwheel.session import build_session

    s = build_session(master="local[*]", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_check():
    from compare import duck

    return duck(SF_CHECK)


@pytest.fixture(scope="session")
def staged_check(spark):
    """sf0.01 shop tables, derived once and written to the checkpoint folder."""
    from cartwheel.sources import open_shop, stage_shop

    stage_shop(spark, SF_CHECK)
    return open_shop(spark, SF_CHECK)
