from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("OMP_NUM_THREADS", "1")

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from ledgerlark.session import SETTINGS
    from pyspark.sql import SparkSession

    got = SparkSession.builder.master("local[4]").config(map=SETTINGS | {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "2g"}).getOrCreate()
    got.sparkContext.setLogLevel("ERROR")
    yield got
    got.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SF
