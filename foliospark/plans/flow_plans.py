"""Queries of the sequential page steps; SQL can't state them, so they are tested on small cases."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import flow
from ..sources.tables import table
from . import documents
from .scalars import pages

QUERIES = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def win20_reflow(spark: SparkSession, d: str) -> DataFrame:
    """(out_id, text): each page with its wrapped lines folded."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([flow.reflow(t) for t in b.column(1).to_pylist()], pa.string())], names=["out_id", "text"])

    return pages(spark, d).select("out_id", "markdown").mapInArrow(run, "out_id bigint, text string")


@query
def win03_merged(spark: SparkSession, d: str) -> DataFrame:
    """(document_id, page_index, seq, kind, text): the blocks of each page, wrapped paragraphs merged."""
    p = table(spark, d, "odl_paragraphs", "para_id", "document_id", "page_index", "kind", "text", "bbox", "ord").where(F.col("document_id").isNotNull() & F.col("text").isNotNull())

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["ord"], r["para_id"]))
        got = flow.merge_paragraphs([{"kind": r["kind"], "text": r["text"], "bbox": r["bbox"]} for r in rows])
        n = len(got)
        return pa.table({"document_id": pa.array([rows[0]["document_id"]] * n, pa.string()), "page_index": pa.array([rows[0]["page_index"]] * n, pa.int32()), "seq": pa.array(range(1, n + 1), pa.int64()), "kind": pa.array([g["kind"] for g in got], pa.string()), "text": pa.array([g["text"] for g in got], pa.string())})

    return p.groupBy("document_id", "page_index").applyInArrow(run, "document_id string, page_index int, seq bigint, kind string, text string")


@query
def jon06_alignment(spark: SparkSession, d: str) -> DataFrame:
    """(out_id, para_id, line_no): blocks of a page with the output line that shares their longest beginning."""
    p = table(spark, d, "odl_paragraphs", "para_id", "document_id", "page_index", "text", "ord").where(F.col("document_id").isNotNull() & F.col("text").isNotNull())
    blocks = p.groupBy("document_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("ord", "para_id", text.norm_block("text").alias("t")))).alias("b"))
    both = pages(spark, d).join(blocks, ["document_id", "page_index"]).select("out_id", F.transform(F.split("markdown", "\n"), text.norm_block).alias("lines"), F.col("b.para_id").alias("ids"), F.col("b.t").alias("texts"))

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for i, ls, ids, ts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out += [(i, k, at + 1) for k, at in zip(ids, flow.align(ts, ls), strict=True) if at is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["out_id", "para_id", "line_no"])

    return both.mapInArrow(run, "out_id bigint, para_id bigint, line_no bigint")


@query
def win22_clusters(spark: SparkSession, d: str) -> DataFrame:
    """(para_id, cluster): blocks of a page whose boxes touch within the gap; a cluster is named by its first block."""
    p = table(spark, d, "odl_paragraphs", "para_id", "document_id", "page_index", "bbox").where(F.col("document_id").isNotNull() & (F.size("bbox") >= 4))

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["para_id"])
        got = flow.clusters([r["bbox"] for r in rows])
        return pa.table({"para_id": pa.array([r["para_id"] for r in rows], pa.int64()), "cluster": pa.array([rows[g]["para_id"] for g in got], pa.int64())})

    return p.groupBy("document_id", "page_index").applyInArrow(run, "para_id bigint, cluster bigint")


@query
def evl04_jon18_tables(spark: SparkSession, d: str) -> DataFrame:
    """(document_id, page_index, seq, similarity): each table of a page against the tables of its normalised output."""
    g = table(spark, d, "odl_tables", "tbl_id", "document_id", "page_index", "label").where(F.col("document_id").isNotNull()).join(documents.evl05_table_html(spark, d), "tbl_id")
    gold = g.groupBy("document_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("tbl_id", "label", "html"))).alias("g"))
    n = table(spark, d, "normalized_pages", "np_id", "document_id", "page_index", "tables_html").where(F.col("document_id").isNotNull() & (F.size("tables_html") > 0))
    got = n.groupBy("document_id", "page_index").agg(F.min_by("tables_html", "np_id").alias("h"))
    both = gold.join(got, ["document_id", "page_index"]).select("document_id", "page_index", F.transform("g", lambda x: F.struct(x["label"], x["html"])).alias("g"), F.transform("h", text.canonical_table).alias("h"))

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for doc, page, gs, hs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                scores = flow.match_tables([tuple(x.values()) for x in gs], [(None, h) for h in hs if h])
                out += [(doc, page, k, s) for k, s in enumerate(scores, 1)]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(4)], names=["document_id", "page_index", "seq", "similarity"])

    return both.mapInArrow(run, "document_id string, page_index int, seq bigint, similarity double")
