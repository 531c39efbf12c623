import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

HERE = Path(__file__).resolve()
sys.path[:0] = [str(HERE.parent), str(HERE.parents[2])]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tallybook-llm-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "3")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared-llm")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def documents(spark):
    """Builds ``documents`` from (doc_id, text) pairs, with extra columns and clashing names."""

    def build(rows, parts=2):
        schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, `odd name` int"
        full = [(i, t, None, "s", len(t) if t is not None else None, "x", 1) for i, t in rows]
        return spark.createDataFrame(full, schema).repartition(parts)

    return build
