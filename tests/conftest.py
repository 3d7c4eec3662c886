import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from eventdocs.session import local_session  # noqa: E402
from eventdocs.schemas import ROSTER  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("4", shuffle_partitions=4, memory="4g")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def two_attendees(spark):
    """The two attendees of the format description."""
    rows = [
        (1, 1, "参加者1", "所属1", "一般", 4000, 6000, 5000, 15000),
        (1, 2, "参加者2", "所属2", "学生", 2000, 0, 2000, 4000),
    ]
    return spark.createDataFrame(rows, ROSTER)


@pytest.fixture(scope="session")
def make_roster(spark):
    def make(sizes: dict[int, int], first: int = 1, step: int = 1):
        rows = [
            (event, first + step * i, f"n{i}", "a", "m", 1000, 0, 0, 1000)
            for event, size in sizes.items()
            for i in range(size)
        ]
        return spark.createDataFrame(rows, ROSTER)

    return make
