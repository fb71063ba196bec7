import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from bandsift.runtime import local_session

    session = local_session(
        8, **{"spark.sql.shuffle.partitions": "2", "spark.default.parallelism": "2"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
