import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from check import session  # noqa: E402
from market_helpers import SF  # noqa: E402

from tickloom.functions.frames import BLOCK_CONF  # noqa: E402
from tickloom.sources.adapters import Tables  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    s = session(**{"spark.python.sql.dataFrameDebugging.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": shared, "spark.sql.warehouse.dir": shared + "/warehouse"})
    yield s
    s.stop()


@pytest.fixture
def tables(spark):
    return Tables(spark, SF)


@pytest.fixture
def small_blocks(spark):
    """Run a plan with short blocks, so that series are cut in many places."""

    def run(make, rows=32):
        spark.conf.set(BLOCK_CONF, str(rows))
        try:
            return make()
        finally:
            spark.conf.unset(BLOCK_CONF)

    return run
