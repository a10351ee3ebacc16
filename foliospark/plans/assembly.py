"""Queries of the assembly entry points: whole documents, catalogue, labels of cells and captions, page scores."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import flow
from ..sources.tables import table
from . import documents, layout, relations
from .relations import _CAP
from .scalars import pages, strip_sql

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query(
    "asm02_assemble",
    f"""SELECT p.document_id, p.page_index, p.markdown, coalesce(f.flags, 0) AS flags, coalesce(u.n, 0) AS unsourced FROM ({documents.SQL['asm03_pages']}) p
    LEFT JOIN (SELECT document_id, page_index, count(*) AS flags FROM ({relations.SQL['jon10_top04_completeness']}) GROUP BY 1, 2) f USING (document_id, page_index)
    LEFT JOIN (SELECT document_id, page_index, count(*) AS n FROM ({relations.SQL['jon09_source_gate']}) GROUP BY 1, 2) u USING (document_id, page_index)""",
)
def asm02_assemble(spark: SparkSession, d: str) -> DataFrame:
    """Each page assembled from its structure, with the number of its dropped and of its unsourced numbers."""
    keys = ["document_id", "page_index"]
    f = relations.jon10_top04_completeness(spark, d).groupBy(*keys).agg(F.count(F.lit(1)).alias("flags"))
    u = relations.jon09_source_gate(spark, d).groupBy(*keys).agg(F.count(F.lit(1)).alias("unsourced"))
    got = documents.asm03_pages(spark, d).join(f, keys, "left").join(u, keys, "left")
    return got.na.fill(0, ["flags", "unsourced"])


@query(
    "asm01_run",
    """SELECT m.document_id, m.source_id, m.run_mode, coalesce(p.pages, 0) AS pages, coalesce(p.n_flags, 0) AS n_flags, coalesce(t.tables, 0) AS tables, coalesce(c.captions, 0) AS captions FROM
    (SELECT document_id, max(source_id) AS source_id, max(run_mode) AS run_mode FROM docmeta WHERE document_id IS NOT NULL GROUP BY 1) m
    LEFT JOIN (SELECT document_id, count(*) AS pages, sum(coalesce(len(flags), 0)) AS n_flags FROM (SELECT DISTINCT out_id, document_id, flags FROM page_outcomes) GROUP BY 1) p USING (document_id)
    LEFT JOIN (SELECT document_id, count(DISTINCT tbl_id) AS tables FROM odl_tables GROUP BY 1) t USING (document_id)
    LEFT JOIN (SELECT document_id, count(DISTINCT cap_id) AS captions FROM odl_captions GROUP BY 1) c USING (document_id)""",
)
def asm01_run(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue row of each document: everything is counted by document before it is joined."""
    m = spark.read.parquet(f"{d}/docmeta.parquet").where(F.col("document_id").isNotNull()).groupBy("document_id").agg(F.max("source_id").alias("source_id"), F.max("run_mode").alias("run_mode"))
    p = relations.agg15_catalog_counts(spark, d).select("document_id", "pages", "n_flags")
    t = table(spark, d, "odl_tables", "document_id", "tbl_id").groupBy("document_id").agg(F.countDistinct("tbl_id").alias("tables"))
    c = table(spark, d, "odl_captions", "document_id", "cap_id").groupBy("document_id").agg(F.countDistinct("cap_id").alias("captions"))
    return m.join(p, "document_id", "left").join(t, "document_id", "left").join(c, "document_id", "left").na.fill(0, ["pages", "n_flags", "tables", "captions"])


@query("snk10_catalog", "SELECT source_id, count(*) AS documents, sum(pages) AS pages, sum(n_flags) AS n_flags FROM (" + SQL["asm01_run"] + ") WHERE source_id IS NOT NULL GROUP BY 1")
def snk10_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue by source."""
    return asm01_run(spark, d).where(F.col("source_id").isNotNull()).groupBy("source_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("pages").alias("pages"), F.sum("n_flags").alias("n_flags"))


@query("scl07_rich_cells", "SELECT DISTINCT tbl_id, r - 1 AS row, c - 1 AS col, cells[r][c] AS text, c = len(cells[r]) AS last FROM (SELECT tbl_id, cells, unnest(range(1, len(cells) + 1)) AS r FROM odl_tables), LATERAL (SELECT unnest(range(1, len(cells[r]) + 1)) AS c) WHERE cells[r][c] IS NOT NULL")
def scl07_rich_cells(spark: SparkSession, d: str) -> DataFrame:
    """One row per cell with its place."""
    t = table(spark, d, "odl_tables", "tbl_id", "cells").select("tbl_id", F.posexplode("cells").alias("row", "cs")).withColumn("n", F.size("cs"))
    return t.select("tbl_id", "row", "n", F.posexplode("cs").alias("col", "text")).where(F.col("text").isNotNull()).select("tbl_id", "row", "col", "text", (F.col("col") == F.col("n") - 1).alias("last")).distinct()


_LABELLED = r"^((?:Fig(?:ure)?|Table|図|表|그림|표)\s*\p{Nd}+[.:]?)\s+([^.．]*[.．]?)"


@query("scl16_bold_captions", f"SELECT DISTINCT cap_id, regexp_replace({strip_sql('text')}, '{_LABELLED}', '**\\1 \\2**') AS md FROM {_CAP} WHERE text IS NOT NULL AND regexp_matches({strip_sql('text')}, '{_LABELLED}')")
def scl16_bold_captions(spark: SparkSession, d: str) -> DataFrame:
    """Captions with label and title sentence in bold."""
    t = text.strip("text")
    return relations.captions(spark, d).where(t.rlike(_LABELLED)).select("cap_id", F.regexp_replace(t, _LABELLED, r"**$1 $2**").alias("md")).distinct()


@query("scl22_authority", f"SELECT h.para_id, CASE WHEN a.para_id IS NOT NULL THEN 'contents' WHEN h.heading_level IS NOT NULL THEN 'declared' ELSE 'none' END AS authority FROM (SELECT DISTINCT para_id, heading_level FROM odl_paragraphs WHERE kind = 'heading' AND text IS NOT NULL AND document_id IS NOT NULL) h LEFT JOIN ({layout.SQL['jon05_authority']}) a USING (para_id)")
def scl22_authority(spark: SparkSession, d: str) -> DataFrame:
    """Where a heading's level may come from: the contents, else its declared level."""
    h = table(spark, d, "odl_paragraphs", "para_id", "document_id", "kind", "heading_level", "text").where((F.col("kind") == "heading") & F.col("text").isNotNull() & F.col("document_id").isNotNull()).select("para_id", "heading_level").distinct()
    a = layout.jon05_authority(spark, d).withColumn("known", F.lit(True))
    return h.join(a, "para_id", "left").select("para_id", F.when(F.col("known"), "contents").when(F.col("heading_level").isNotNull(), "declared").otherwise("none").alias("authority"))


@query(
    "evl02_pages",
    f"""SELECT out_id, f1, recall, hallucination, CASE WHEN length(src) = 0 THEN 0.0 ELSE least(1.0, length(markdown) / length(src)) END AS coverage FROM ({relations.SQL['set02_f1']}) JOIN ({relations.SQL['set03_number_recall']}) USING (out_id) JOIN (SELECT out_id, markdown, src FROM ({relations._PAIR})) USING (out_id)""",
)
def evl02_pages(spark: SparkSession, d: str) -> DataFrame:
    """The scores of each page against its source, from one pass over the pairs."""
    nums = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\p{Nd}[\p{Nd},.]{3,}"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(""))))
    p = relations.page_pairs(spark, d).withColumns({"o": nums("markdown"), "g": nums("src")}).withColumn("n", F.size(F.array_intersect("o", "g")))
    return p.select(
        "out_id", text.set_f1(F.col("a"), F.col("b")).alias("f1"), F.when(F.size("g") == 0, 1.0).otherwise(F.col("n") / F.size("g")).alias("recall"),
        F.when(F.size("o") == 0, 0.0).otherwise((F.size("o") - F.col("n")) / F.size("o")).alias("hallucination"),
        F.when(F.length("src") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.length("markdown") / F.length("src"))).alias("coverage"),
    )


@query("win15_stitched")
def win15_stitched(spark: SparkSession, d: str) -> DataFrame:
    """(document_id, markdown): the pages of each document joined, paragraphs that a page break cuts made whole."""
    got = pages(spark, d).where(F.col("document_id").isNotNull()).select("document_id", "page_index", "out_id", "markdown")

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["page_index"], r["out_id"]))
        return pa.table({"document_id": pa.array([rows[0]["document_id"]], pa.string()), "markdown": pa.array([flow.stitch([r["markdown"] for r in rows])], pa.string())})

    return got.groupBy("document_id").applyInArrow(run, "document_id string, markdown string")


@query("win21_relevel")
def win21_relevel(spark: SparkSession, d: str) -> DataFrame:
    """(out_id, text): each page with its numbered headings at the level of their numbering."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([flow.relevel(t) for t in b.column(1).to_pylist()], pa.string())], names=["out_id", "text"])

    return pages(spark, d).select("out_id", "markdown").mapInArrow(run, "out_id bigint, text string")


@query("src24_titles_in_meta", "SELECT DISTINCT document_id, k AS key, producer[k] AS value FROM (SELECT document_id, producer, unnest(map_keys(producer)) AS k FROM docmeta WHERE document_id IS NOT NULL)")
def src24_titles_in_meta(spark: SparkSession, d: str) -> DataFrame:
    """Every key of the producer's record with its value."""
    m = spark.read.parquet(f"{d}/docmeta.parquet").where(F.col("document_id").isNotNull())
    return m.select("document_id", F.explode("producer").alias("key", "value")).distinct()


