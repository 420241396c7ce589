import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.log.structuredLogging.enabled", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    connection = duckdb.connect()
    for path in Path(data).iterdir():
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*' if path.is_dir() else ''}'")
    return connection


def compared(ours, theirs):
    """Both frames with columns and rows in the same order, missing values alike."""
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    frames = []
    for frame in (ours, theirs):
        frame = frame[columns].astype(object)
        frames.append(sorted(tuple(None if x != x else x for x in row) for row in frame.itertuples(index=False)) if len(frame) else [])
    return frames


@pytest.fixture(scope="session")
def same_rows():
    def check(ours, theirs):
        a, b = compared(ours, theirs)
        assert len(a) == len(b)
        assert a == b

    return check
