"""Every registered vector query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from quiverlake.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("embeddings", "events"):
        con.execute(f"create view {name} as select * from read_parquet('{DATA}/{name}.parquet')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    found, expected = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


def test_entry_works_without_the_llm_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['quiverlake.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 30 and e.oracle_sql(); assert not [n for n in e.queries() if n.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(__file__)))
