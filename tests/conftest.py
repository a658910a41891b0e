import sys
import tempfile
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-")}
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same(spark, data, duck):
    def check(query, sql):
        got, want = query(spark, data).toPandas(), duck.sql(sql).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns and len(want) > 0
        rows = lambda df: sorted(map(str, df[columns].astype(object).itertuples(index=False, name=None)))
        plain = lambda df: df.assign(**{c: df[c].map(lambda v: None if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)) for c in columns})
        assert rows(plain(got)) == rows(plain(want))

    return check
