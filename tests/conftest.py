import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from attesta.settings import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    built = session("tests", **{
        "spark.master": "local[4]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    built.sparkContext.setLogLevel("ERROR")
    if built.conf.get("spark.checkpoint.dir", None) is None:
        built.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    return built
