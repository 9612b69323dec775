import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyframe.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]",
        **{
            "spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def sample_days():
    """A hundred days around a leap day; every column follows from the number of the row, by whole-number rules."""
    import datetime

    rows = []
    for i in range(100):
        day = datetime.date(2024, 2, 20) + datetime.timedelta(days=i)
        revenue = 800 + 12.25 * i + 10.5 * (i * i % 17)
        rows.append((
            str(day), 20 + 7 * i % 31, revenue, int(i % 7 == 3), (70 + 3 * i % 25) / 100,
            ("Basic", "Team", "Scale")[(i * i + i) // 2 % 5 % 3], 5 + 11 * i % 40, 250 + 4.75 * (13 * i % 90),
        ))
    return rows


@pytest.fixture(scope="session")
def sample(spark):
    """``sample_days`` with a column for each role."""
    names = "date string, users long, revenue double, churn long, retention double, plan string, engagement long, ltv double"
    return spark.createDataFrame(sample_days(), names).cache()
