import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from parity import session

    return session("4")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
