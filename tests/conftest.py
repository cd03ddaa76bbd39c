import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from fleetlens.session import build_session, drop_staged

    shared = tmp_path_factory.mktemp("shared")
    session = build_session(
        "local[8]", 4, **{
            "spark.checkpoint.dir": str(shared), "spark.ui.enabled": "false", "spark.driver.memory": "6g",
            "spark.sql.streaming.stateStore.maintenanceInterval": "600s",
        }
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_staged(session)
    session.stop()
