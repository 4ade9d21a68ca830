from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
for p in (ROOT, ROOT / "tests"):
    if str(p) not in sys.path:
        sys.path.insert(0, str(p))

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from strandloom.session import get_session

    s = get_session("tests", 4, **{"spark__sql__shuffle__partitions": "4", "spark__driver__memory": "4g", "spark__checkpoint__dir": str(tmp_path_factory.mktemp("checkpoint"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf():
    if not DATA.exists():
        pytest.skip("no test tables here")
    return str(DATA)
