import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mnemospark.session import session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session(master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.fixture
def files(spark, tmp_path):
    """Writes rows as a table that is read from files, as tables are."""

    def write(rows, schema, name="t", parts=1):
        path = str(tmp_path / f"{name}.parquet")
        spark.createDataFrame(rows, schema).coalesce(parts).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return write
