import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpuslens.session import local_session  # noqa: E402
from support import SMALL_APP, as_files  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tests")


@pytest.fixture()
def small_app(spark):
    from corpuslens.operators.inventory import inventory

    return inventory(as_files(spark, SMALL_APP))
