import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(autouse=True)
def no_keys(monkeypatch):
    """Tests call no real model, whatever keys are set where they run, and few tasks call the others."""
    from lensaudit.operators import calls, embedding, providers

    monkeypatch.setattr(calls, "PARTS", 2)
    monkeypatch.setattr(embedding, "PARTS", 2)

    for name in list(os.environ):
        if providers.detect({name: "x"}):
            monkeypatch.delenv(name)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
