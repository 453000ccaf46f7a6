import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from inodelake.runtime import session

    s = session("tests", "4", **{"spark.sql.shuffle.partitions": "3", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rounded(rows):
    """Rows that can be compared and sorted, doubles to nine digits."""
    return sorted(tuple("~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Runs a query in Spark and its SQL in DuckDB and compares all rows."""

    def check(run, sql):
        got = run(spark, SF)
        names = sorted(got.columns)
        want = duck.execute(sql)
        at = {d[0]: k for k, d in enumerate(want.description)}
        assert sorted(at) == names
        theirs = [[r[at[n]] for n in names] for r in want.fetchall()]
        assert rounded(tuple(r) for r in got.select(*names).collect()) == rounded(theirs)

    return check
