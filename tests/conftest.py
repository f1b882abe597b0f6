from __future__ import annotations

import pytest

from tests.session import make_session


@pytest.fixture(scope="session")
def spark():
    return make_session(os_cpus())


def os_cpus() -> str:
    import os
    return os.environ.get("TEST_CPUS", "8")


@pytest.fixture()
def sf():
    import os
    return f"/root/testdata/sf{os.environ.get('TEST_SF', '0.001')}"
