import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


def pytest_configure(config):
    config.addinivalue_line("markers", "slow: full-size model fits")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def posting_rows(spark, rows):
    """Postings with the given fields; all other fields are null."""
    from adsift.sources.postings import POSTING_SCHEMA

    names = POSTING_SCHEMA.names
    full = [tuple({"job_id": i, **r}.get(n) for n in names) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, POSTING_SCHEMA)


def column(df, *names, order="job_id"):
    """Values (or tuples) of columns in key order."""
    rows = df.orderBy(order).select(*[f"`{n}`" for n in names]).collect()
    return [r[0] if len(names) == 1 else tuple(r) for r in rows]
