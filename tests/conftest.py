from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from oracle import make_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return make_spark()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
