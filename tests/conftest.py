import os

import pytest

os.environ.setdefault("PYSPARK_PYTHON", os.environ.get("PYSPARK_PYTHON", "python"))


@pytest.fixture(scope="session")
def spark():
    from loomstead.session import build_session

    session = build_session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    yield session
    session.stop()
