import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
    for t in names.split():
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def same_rows(spark_df, duck_df):
    """Whether both have the same columns and rows, in any order."""
    a = spark_df.toPandas()
    assert sorted(a.columns) == sorted(duck_df.columns)
    k = sorted(a.columns)
    a, b = (x[k].astype(object).where(x[k].notna(), None).map(str).sort_values(k).reset_index(drop=True) for x in (a, duck_df))
    assert len(a) == len(b)
    for c in k:
        pairs = [(x, y) for x, y in zip(a[c], b[c]) if x != y and not _close(x, y)]
        assert not pairs, (c, pairs[:3])


def _close(x, y):
    try:
        return abs(float(x) - float(y)) < 1e-6
    except ValueError:
        return False
