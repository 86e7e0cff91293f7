import math
import os
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[1])]
# Workers import the library by name.
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from passagemill.session import session

    made = session(
        "tests",
        **{
            "spark.master": "local[4]",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    made.sparkContext.setLogLevel("OFF")
    made.sparkContext.setCheckpointDir(f"file://{tmp_path_factory.mktemp('shared')}")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return repr(v)


@pytest.fixture(scope="session")
def same():
    """Whether a Spark result and a DuckDB result have the same columns and rows, in any order."""

    def check(df, relation):
        mine, theirs = df.columns, relation.columns
        assert sorted(mine) == sorted(theirs)
        order = sorted(mine)
        a = sorted(tuple(cell(r[k]) for k in order) for r in df.collect())
        b = sorted(tuple(cell(r[theirs.index(k)]) for k in order) for r in relation.fetchall())
        assert a == b

    return check
