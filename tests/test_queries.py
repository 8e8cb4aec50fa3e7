"""Every query that SQL can express equals DuckDB on the smallest tables; the others are in test_bruteforce.py."""

import glob
import os

import duckdb
import pytest

from tidemark.plans import catalogue

DATA = "/root/testdata/sf0.001"
@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    return int(v) if isinstance(v, float) and v.is_integer() else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    want = duck.execute(catalogue.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())


def test_few_queries_lack_sql():
    rest = set(catalogue.QUERIES) - set(catalogue.SQL)
    assert rest == {"near_repeats", "false_starts", "similar_segments", "repeat_candidates", "audio_anchors", "offset_segments", "recovered_keep", "greedy_clusters", "cleaned_pages", "filled_holes"}
