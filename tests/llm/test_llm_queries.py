"""Each query of the subpackage: columns, distinct rows, and p3 against its SQL."""

import duckdb
import pytest

from foliospark.llm.queries import QUERIES, SQL

TINY = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["para_id", "end_pos"], "p2_found": ["rec", "id_a", "id_b"], "p2_forms": ["rec", "id", "text", "form", "folded"], "p3_found": ["para_id"],
    "p4_found": ["rec", "row_id", "elem", "seq"], "p5_found": ["rec", "rec_key", "lang"], "p6_found": ["rec", "row_id", "line_no", "fix"], "p7_ids": ["doc_id", "ids"],
    "p8_packs": ["capacity_id", "container_id", "doc_id", "piece", "tokens"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_distinct_rows(spark, name):
    df = QUERIES[name](spark, TINY)
    assert df.columns == COLUMNS[name]
    assert df.count() == df.distinct().count() > 0


def test_sizes_against_sql(spark):
    con = duckdb.connect()
    for t in ("docmeta", "odl_paragraphs", "chunk_policy"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    want = {r[0] for r in con.execute(SQL["p3_found"]).fetchall()}
    assert {r.para_id for r in QUERIES["p3_found"](spark, "/root/testdata/sf0.01").collect()} == want
