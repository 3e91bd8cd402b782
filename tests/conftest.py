import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from photarium.session import session

    folder = tmp_path_factory.mktemp("spark")
    s = session(
        "local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{folder}/shared", "spark.sql.warehouse.dir": f"{folder}/warehouse"}
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    db = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def plain(value):
    """One form for the values of both engines."""
    import math

    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 6) + 0.0 if math.isfinite(value) else str(value)
    return value.isoformat() if hasattr(value, "isoformat") else value


@pytest.fixture(scope="session")
def same(duck):
    def check(df, sql):
        cursor = duck.execute(sql)
        names = [c[0] for c in cursor.description]
        theirs = [dict(zip(names, row)) for row in cursor.fetchall()]
        ours = [r.asDict() for r in df.collect()]
        assert sorted(names) == sorted(df.columns)
        key = lambda row: repr([plain(row[n]) for n in sorted(names)])
        assert sorted(map(key, ours)) == sorted(map(key, theirs))
        return len(ours)

    return check
