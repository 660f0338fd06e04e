import tempfile

import pytest

from assocgraph.session import build


@pytest.fixture(scope="session")
def spark():
    session = build(
        "tests",
        **{"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.local.dir": tempfile.mkdtemp(prefix="spark-"), "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-")},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
