import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import os

    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        p = f"{DATA}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    if hasattr(v, "asDict"):
        return repr({k: plain(x) for k, x in v.asDict().items()})
    if isinstance(v, list | tuple):
        return repr([plain(x) for x in v])
    return repr(v)


@pytest.fixture(scope="session")
def same_rows(duck):
    """Whether a DataFrame and SQL have the same columns and rows, order aside."""

    def check(df, sql):
        cols = sorted(df.columns)
        got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
        cur = duck.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())

    return check
