import os

import pytest
from pyspark.sql import SparkSession

from revlens.plans.enrich import enrich
from revlens.session import configure
from revlens.sources.reviews import read_reviews

FIXTURE = os.path.join(os.path.dirname(__file__), "fixtures", "reviews.csv")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def raw(spark):
    return read_reviews(spark, FIXTURE)


@pytest.fixture(scope="session")
def enriched(raw):
    return enrich(raw).persist()


def rows(df, *order):
    """Rows as dictionaries in the given order."""
    out = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(out, key=lambda r: tuple((r[c] is None, r[c]) for c in order)) if order else out
