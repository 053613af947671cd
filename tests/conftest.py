import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = str(Path(__file__).resolve().parent.parent) + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    return SMALL


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{small}/{name}.parquet')")
    return con


def comparable(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if value != value else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(comparable(v) for v in value)
    return value


@pytest.fixture(scope="session")
def same_rows(duck):
    """Compares a DataFrame with SQL: columns by name, rows in any order."""

    def check(df, sql):
        names = sorted(df.columns)
        mine = [tuple(comparable(r[c]) for c in names) for r in df.collect()]
        cursor = duck.execute(sql)
        cols = [d[0] for d in cursor.description]
        assert names == sorted(cols)
        theirs = [tuple(comparable(dict(zip(cols, r, strict=True))[c]) for c in names) for r in cursor.fetchall()]
        key = lambda r: tuple((v is None, str(v)) for v in r)
        assert sorted(mine, key=key) == sorted(theirs, key=key)

    return check
