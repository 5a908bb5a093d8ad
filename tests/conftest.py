import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]


@pytest.fixture(scope="session")
def spark():
    from gneiss.session import local_session

    session = local_session(cores="4", shuffle=4)
    session.sparkContext.setLogLevel("ERROR")
    return session
