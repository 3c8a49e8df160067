import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[2]}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text) become a documents table with further columns, some of whose names clash with those of results."""

    def make(rows):
        wide = [(i, t, "en", f"s{k % 3}", None if t is None else len(t), k) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(wide, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int")

    return make
