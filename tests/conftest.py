import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from corpusmill.session import make_session, ship


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = make_session("local[4]", "tests", 4, str(tmp_path_factory.mktemp("shared")), spark__driver__memory="3g")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
