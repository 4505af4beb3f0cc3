import os
import subprocess
import sys
from decimal import Decimal

import duckdb
import pytest

from sonarium.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark".split()


def plain(rows):
    return sorted(tuple(str(round(float(v), 6)) if isinstance(v, (float, Decimal)) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    if name in catalogue.SQL:
        rel = duck.sql(catalogue.SQL[name])
        assert sorted(rel.columns) == columns
        assert plain(rows) == plain([tuple(r[rel.columns.index(c)] for c in columns) for r in rel.fetchall()])


def test_query_names_and_sql_agree():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
    # Only sums in Python can check these.
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"o109_lock_shard"}


def test_entry_points_do_without_the_corpus_operators():
    """With a library missing that only they need, all other queries are there."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; n = e.queries(); assert 'o070_gauges' in n and 'op9_probminhash' not in n and 'pipeline' not in n; assert e.oracle_sql()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
