"""One small session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false"}
    builder = SparkSession.builder.master("local[4]")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
