import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from granary.session import local_session, prepare

    session = local_session(8, 4, "6g")
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
