import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .appName("keylink-tests")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def table(spark):
    """Builds a DataFrame from rows and a DDL schema."""
    from keylink.functions.frames import metadata_frame

    return lambda schema, rows: metadata_frame(spark, rows, schema)


@pytest.fixture
def links(spark):
    """Runs a discovery and returns {(fk table.column, pk table.column): miss ratio}."""
    from keylink import Params, Source, discover

    def run(tables, params=None, **options):
        source = Source("db", tables)
        rows = discover(spark, source, params or Params.ungated(), **options).collect()
        found = {
            (f"{r['table2']}.{r['column2']}", f"{r['table1']}.{r['column1']}"):
                r["matching_degree"]
            for r in rows
        }
        assert len(found) == len(rows)
        return found

    return run
