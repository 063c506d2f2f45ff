from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[2])
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def workers_find_the_library(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT


@pytest.fixture
def small():
    if not Path(SMALL).exists():
        pytest.skip("no test tables")
    return SMALL


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with a column whose name clashes with those the operators make up."""

    def make(rows, extra=True):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        return frame.selectExpr("*", "'x' AS id", "1 AS n", "'y' AS row_key", "'z' AS text_2") if extra else frame

    return make
