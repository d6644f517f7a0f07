import datetime
import decimal
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from bindery.session import session
    from bindery.streaming import run

    run.STATE_PARTITIONS = 2  # few keys: each partition of a stream's state costs a worker in each micro-batch
    s = session("local[4]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def canonical(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="session")
def agrees(spark, duck):
    """Whether a query and its SQL give the same rows and columns over the smallest tables."""

    def check(query, sql):
        df = query(spark, DATA)
        cols = sorted(df.columns)
        got = sorted(tuple(canonical(r[c]) for c in cols) for r in df.collect())
        r = duck.execute(sql)
        names = [x[0] for x in r.description]
        assert sorted(names) == cols
        assert got == sorted(tuple(canonical(x[names.index(c)]) for c in cols) for x in r.fetchall())

    return check
