import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("provender-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def rules():
    from provender.rules.ruleset import RuleSet

    return RuleSet.starter()


@pytest.fixture(scope="session")
def make_rows(spark):
    """Rows of (group, category, primary, product type, product name), numbered."""

    def make(rows):
        from provender import schema as S

        columns = [S.FPG, S.FPC, S.PFPC, S.PRODUCT_TYPE, S.PRODUCT_NAME]
        ddl = "row_id long, " + ", ".join(f"`{c}` string" for c in columns)
        return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], ddl)

    return make
