import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kgweave.plans.workspace import Workspace  # noqa: E402
from kgweave.sources.inline import triples  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("kgweave-tests")
        .config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    Workspace.of(session).release()
    session.stop()


@pytest.fixture(scope="session")
def graph(spark):
    return lambda rows: triples(spark, [tuple(r) for r in rows])


def rows(df):
    return {tuple(r) for r in df.collect()}
