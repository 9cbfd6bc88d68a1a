import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[8]", 8, "6g")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture
def small_pieces(monkeypatch):
    """Chunks and blocks of a few rows, so that short series cross many of their borders."""
    from tickloom.operators import core
    monkeypatch.setattr(core, "CHUNK_BARS", 7)
    monkeypatch.setattr(core, "MIN_BLOCK", 5)
