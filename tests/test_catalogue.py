"""Every query of the core against its SQL on DuckDB, and every one on empty tables."""

import glob
import os

import duckdb
import pytest

from foliospark.plans import catalogue

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{TINY}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if isinstance(v, list):
        return tuple(map(plain, v))
    try:
        return float(f"{float(v):.9g}")
    except (TypeError, ValueError):
        return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, TINY)
    want = con.execute(catalogue.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for t in ("docmeta", "odl_paragraphs", "odl_tables", "odl_captions", "page_outcomes", "normalized_pages", "chunk_policy", "documents"):
        spark.read.parquet(f"{TINY}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return str(d)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_empty_tables(spark, nothing, name):
    assert catalogue.QUERIES[name](spark, nothing).collect() == []
