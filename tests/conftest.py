from __future__ import annotations

import pytest

from postlake.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    extra = {
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "6g",
        "spark.master": "local[8]",
    }
    session = build_session("tests", **extra)
    session.sparkContext.setLogLevel("ERROR")
    return session
