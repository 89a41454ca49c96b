import glob
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


@pytest.fixture(scope="session")
def agree(spark, sf, duck, tmp_path_factory):
    """Run a query and its SQL twin; both must give the same rows, names and types."""

    def run(query, sql):
        df = query(spark, sf)
        out = str(tmp_path_factory.mktemp("q")) + "/o"
        df.write.parquet(out)
        names = ", ".join(f'"{c}"' for c in sorted(df.columns))
        duck.sql(f"CREATE OR REPLACE TABLE want AS SELECT {names} FROM ({sql})")
        duck.sql(f"CREATE OR REPLACE TABLE got AS SELECT {names} FROM '{out}/*.parquet'")
        assert sorted(duck.sql(f"SELECT * FROM ({sql}) LIMIT 0").columns) == sorted(df.columns)
        assert duck.sql("DESCRIBE want").fetchall() == duck.sql("DESCRIBE got").fetchall()
        for a, b in (("want", "got"), ("got", "want")):
            assert duck.sql(f"SELECT * FROM {a} EXCEPT ALL SELECT * FROM {b} LIMIT 3").fetchall() == [], f"rows of {a} missing from {b}"

    return run
