from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from colloquy.session import build_session  # noqa: E402
from colloquy.streaming.episodes import STATE_STORE  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = build_session(
        "tests", cores="4", shuffle_partitions=4, spark__sql__streaming__stateStore__providerClass=STATE_STORE,
        spark__checkpoint__dir=f"file://{folder}/checkpoint", spark__sql__warehouse__dir=f"{folder}/warehouse",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
