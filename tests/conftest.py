import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from siltstone.session import local

    s = local(4, "4g", 4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL
