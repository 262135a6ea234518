import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
# functions the tests hand to Python workers live in these modules
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("siftgate-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    from siftgate.sources.storage import ship

    ship(session)
    yield session
    session.stop()


@pytest.fixture
def texts(spark):
    """Build ``(doc_id, text)`` from a list of strings."""

    def build(values):
        return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")

    return build


def column(df, name, key="doc_id"):
    return [r[name] for r in df.orderBy(key).collect()]
