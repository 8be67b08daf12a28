import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return str(DATA)


@pytest.fixture(scope="session", autouse=True)
def one_walk(request):
    """The price walk that most queries begin with is computed once for each table, not once for each query."""
    if not any("spark" in getattr(item, "fixturenames", ()) for item in request.session.items):
        yield
        return
    from barloom.sources import bars

    made, walk = {}, bars.walk

    def kept(spark, sf_dir, key="brand"):
        if (sf_dir, key) not in made:
            made[sf_dir, key] = walk(spark, sf_dir, key).cache()
        return made[sf_dir, key]

    bars.walk = kept
    yield
    bars.walk = walk
