import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from millrace.session import SEMANTICS

    builder = SparkSession.builder.master("local[4]").appName("tests")
    settings = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.driver.memory": "4g", "spark.sql.files.maxPartitionBytes": "4m", **SEMANTICS}
    for k, v in settings.items():
        builder = builder.config(k, v)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rel(spark):
    """rel("id integer, name varchar", rows) makes a relation with those declared types."""
    from millrace.plans.relation import Column, Relation
    from millrace.functions import types
    from pyspark.sql import types as T

    def make(columns: str, rows: list[tuple]) -> Relation:
        named = [c.strip().split(" ", 1) for c in columns.split(",")]
        schema = T.StructType([T.StructField(n, types.parse(t)) for n, t in named])
        return Relation(spark.createDataFrame(rows, schema), tuple(Column(n, t) for n, t in named))

    return make
