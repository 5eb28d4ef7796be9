from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from chronoweave.sources.shipping import ship

    ship(session)
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """The value of a column expression for one text."""
    from pyspark.sql import functions as F

    def value(f, text):
        return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first()["v"]

    return value


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)
