import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent
sys.path[:0] = [str(HERE), str(HERE.parent)]

from micro_ledger import MICRO_ACCOUNTS, MICRO_SPLITS, MICRO_TRANSACTIONS, make_ledger  # noqa: E402
from tallybook.operators.journal import with_journal  # noqa: E402
from tallybook.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("tallybook-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    )
    session = configure(builder, shuffle_partitions=2).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def micro(spark):
    return make_ledger(spark, MICRO_ACCOUNTS, MICRO_TRANSACTIONS, MICRO_SPLITS)


@pytest.fixture(scope="session")
def micro_with_journal(spark, micro):
    return with_journal(micro)
