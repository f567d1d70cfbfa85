import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cairn import session

    s = session.local_session(cpus=4, app="cairn-tests", memory="4g")
    session.ship(s)
    yield s
    s.stop()
