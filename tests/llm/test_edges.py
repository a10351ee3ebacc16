"""Every query on empty tables, and on tables of nulls, blanks, repeats, very long texts and columns with clashing names."""

import datetime

import pytest
from pyspark.sql import functions as F

from foliospark.llm.queries import QUERIES

TINY = "/root/testdata/sf0.001"
TABLES = ("docmeta", "odl_paragraphs", "odl_tables", "odl_captions", "page_outcomes", "normalized_pages", "chunk_policy", "documents", "pack_capacity")
TEXT = {"odl_paragraphs": "text", "odl_tables": "label", "odl_captions": "text", "page_outcomes": "markdown", "normalized_pages": "markdown", "documents": "text"}
KEY = {"odl_paragraphs": "para_id", "odl_tables": "tbl_id", "odl_captions": "cap_id", "page_outcomes": "out_id", "normalized_pages": "np_id", "documents": "doc_id"}
LONG = "The storage tank was moved to the upper floor, and no one saw it. " * 4000
ODD = [None, "", " ", "\n\n", "​", "…", "12", "x" * 30000, "日本語" * 8000, LONG, "# a\n- b\n```\nopen", "$$", "<td", "\\begin{", "a\x00b", "😀" * 50, "ab-\n", "-\n-\n", "|\n|-"]


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        df = spark.read.parquet(f"{TINY}/{t}.parquet")
        (df if t in ("chunk_policy", "pack_capacity") else df.limit(0)).write.parquet(f"{d}/{t}.parquet")
    return str(d)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    for t in TABLES:
        df = spark.read.parquet(f"{TINY}/{t}.parquet")
        if t in TEXT:
            texts = spark.createDataFrame([(i, x) for i, x in enumerate(ODD * 2)], "n int, body string")
            blank = texts.select(*[
                F.col("body").alias(c) if c == TEXT[t] else F.col("n").cast(k).alias(c) if c == KEY[t] else F.when(F.col("n") % 3 > 0, F.lit("d1" if c == "document_id" else None)).cast(k).alias(c)
                if k == "string" else F.lit(None).cast(k).alias(c)
                for c, k in df.dtypes
            ])
            df = blank.union(blank.limit(9))
        elif t == "docmeta":
            row = {"document_id": "d1", "ingested_at": datetime.datetime(2024, 1, 1)}
            df = spark.createDataFrame([tuple(row.get(c) for c in df.columns)] * 2 + [tuple(None for _ in df.columns)], df.schema)
        for extra in ("langs", "size", "form", "key", "n", "score", "ids", "rank", "salt", "fix"):
            df = df.withColumn(extra, F.lit("clash"))
        df.write.parquet(f"{d}/{t}.parquet")
    return str(d)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_tables(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
    if name == "p7_ids":
        assert len(rows) == 2 * len(ODD) + 9 and all(r.ids is not None for r in rows)
    if name == "p3_found":
        assert {r.para_id for r in rows} >= {i for i, x in enumerate(ODD) if x == LONG}
    if name == "p8_packs":
        assert {r.doc_id for r in rows} == set(range(2 * len(ODD)))
