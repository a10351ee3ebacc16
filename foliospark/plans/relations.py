"""Queries of joins, aggregations, windows, samples and set operators over the extracted-document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..sources.tables import latest, table
from .scalars import _LINES, PAGES, W, _quote, lines, numbers_sql, pages, strip_sql, tokens_sql

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- joins ----------------------------------------------------------------------------------------------------

_TBL = "(SELECT DISTINCT tbl_id, document_id, page_index, table_id, previous_table_id, bbox, label, caption_id, ord FROM odl_tables WHERE document_id IS NOT NULL)"
_CAP = "(SELECT DISTINCT cap_id, document_id, page_index, bbox, text, element_id, linked_content_id FROM odl_captions WHERE document_id IS NOT NULL)"


def tables(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "odl_tables", "tbl_id", "document_id", "page_index", "table_id", "previous_table_id", "bbox", "label", "caption_id", "ord").where(F.col("document_id").isNotNull())


def captions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "odl_captions", "cap_id", "document_id", "page_index", "bbox", "text", "element_id", "linked_content_id").where(F.col("document_id").isNotNull())


@query("jon01_linked", f"SELECT DISTINCT c.cap_id, t.tbl_id FROM {_CAP} c JOIN {_TBL} t ON c.document_id = t.document_id AND c.linked_content_id = t.table_id")
def jon01_linked(spark: SparkSession, d: str) -> DataFrame:
    """Captions bound to tables by their link."""
    c, t = captions(spark, d).select("cap_id", "document_id", F.col("linked_content_id").alias("table_id")), tables(spark, d).select("tbl_id", "document_id", "table_id")
    return c.join(t, ["document_id", "table_id"]).select("cap_id", "tbl_id").distinct()


_DIST = "sqrt(pow((c.bbox[1] + c.bbox[3]) / 2 - (t.bbox[1] + t.bbox[3]) / 2, 2) + pow((c.bbox[2] + c.bbox[4]) / 2 - (t.bbox[2] + t.bbox[4]) / 2, 2))"


def _distance(a: str, b: str):
    cx = lambda x: (F.col(x)[0] + F.col(x)[2]) / 2
    cy = lambda x: (F.col(x)[1] + F.col(x)[3]) / 2
    return F.sqrt(F.pow(cx(a) - cx(b), F.lit(2.0)) + F.pow(cy(a) - cy(b), F.lit(2.0)))


@query(
    "jon01_nearest",
    f"""SELECT cap_id, arg_min(tbl_id, (dist, tbl_id)) AS tbl_id, min(dist) AS dist FROM (
      SELECT c.cap_id, t.tbl_id, {_DIST} AS dist FROM {_CAP} c JOIN {_TBL} t ON c.document_id = t.document_id AND c.page_index = t.page_index
      WHERE c.linked_content_id IS NULL AND c.bbox IS NOT NULL AND t.bbox IS NOT NULL AND regexp_matches({strip_sql('c.text')}, {_quote(text.TABLE_LABEL)})) GROUP BY cap_id""",
)
def jon01_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Unlinked table captions bound to the nearest table of their page, by centre distance."""
    c = captions(spark, d).where(F.col("linked_content_id").isNull() & F.col("bbox").isNotNull() & text.strip("text").rlike(text.TABLE_LABEL))
    t = tables(spark, d).where(F.col("bbox").isNotNull()).select("document_id", "page_index", "tbl_id", F.col("bbox").alias("tb"))
    near = c.join(t, ["document_id", "page_index"]).select("cap_id", "tbl_id", _distance("bbox", "tb").alias("dist"))
    return near.groupBy("cap_id").agg(F.min_by("tbl_id", F.struct("dist", "tbl_id")).alias("tbl_id"), F.min("dist").alias("dist"))


_LABEL = f"lower(regexp_replace({strip_sql('label')}, {_quote(f'[{W}]+')}, ' ', 'g'))"
_PTEXT = f"lower(regexp_replace(text, {_quote(f'[{W}]+')}, ' ', 'g'))"


@query(
    "jon04_cross_references",
    f"""WITH l AS (SELECT DISTINCT document_id, tbl_id, {_LABEL} AS label FROM {_TBL} WHERE label IS NOT NULL AND {_LABEL} <> ''),
    p AS (SELECT DISTINCT document_id, para_id, {_PTEXT} AS t FROM odl_paragraphs WHERE text IS NOT NULL AND document_id IS NOT NULL)
    SELECT DISTINCT para_id, tbl_id FROM p JOIN l ON p.document_id = l.document_id WHERE strpos(t, label) > 1 AND NOT regexp_matches(substr(t, strpos(t, label) + length(label), 1), '^\\p{{Nd}}')""",
)
def jon04_cross_references(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs that name a table's label, not at their head and not before another digit."""
    one = lambda c: F.lower(F.regexp_replace(c, rf"[{W}]+", " "))
    t = tables(spark, d).select("document_id", "tbl_id", one(text.strip("label")).alias("label")).where(F.length("label") > 0).distinct()
    p = table(spark, d, "odl_paragraphs", "document_id", "para_id", "text").where(F.col("text").isNotNull()).select("document_id", "para_id", one("text").alias("t"))
    at = F.expr("locate(label, t)")
    nxt = F.expr("substring(t, locate(label, t) + length(label), 1)")
    return p.join(t, "document_id").where((at > 1) & ~nxt.rlike(r"^\p{Nd}")).select("para_id", "tbl_id").distinct()


_PAGE_NUMBERS = f"SELECT DISTINCT document_id, page_index, unnest({numbers_sql('text')}) AS number FROM odl_paragraphs WHERE document_id IS NOT NULL AND text IS NOT NULL"
_OUT_NUMBERS = f"SELECT DISTINCT document_id, page_index, unnest({numbers_sql('markdown')}) AS number FROM page_outcomes WHERE document_id IS NOT NULL AND markdown IS NOT NULL"


def source_numbers(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "odl_paragraphs", "document_id", "page_index", "text").where(F.col("document_id").isNotNull())
    return p.select("document_id", "page_index", F.explode(text.numbers("text")).alias("number")).distinct()


def output_numbers(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d).where(F.col("document_id").isNotNull())
    return p.select("document_id", "page_index", F.explode(text.numbers("markdown")).alias("number")).distinct()


@query("jon09_source_gate", f"SELECT o.* FROM ({_OUT_NUMBERS}) o ANTI JOIN ({_PAGE_NUMBERS}) s USING (document_id, page_index, number) WHERE coalesce(try_cast(o.number AS DOUBLE) >= 1000, false)")
def jon09_source_gate(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of 1000 or more of a page's output that its source doesn't hold."""
    big = F.coalesce(F.col("number").try_cast("double") >= 1000, F.lit(False))
    return output_numbers(spark, d).where(big).join(source_numbers(spark, d), ["document_id", "page_index", "number"], "left_anti")


_RECUR = f"SELECT document_id, number, count(*) AS n_pages FROM ({_PAGE_NUMBERS}) GROUP BY 1, 2"
_NPAGES = "SELECT document_id, count(DISTINCT page_index) AS pages FROM odl_paragraphs WHERE document_id IS NOT NULL AND text IS NOT NULL GROUP BY 1"


@query("agg01_recurring", f"SELECT document_id, number, n_pages FROM ({_RECUR}) JOIN ({_NPAGES}) USING (document_id) WHERE pages >= 2 AND n_pages >= greatest(2, CAST(floor(pages * 0.5) AS INTEGER))")
def agg01_recurring(spark: SparkSession, d: str) -> DataFrame:
    """Numbers on half of a document's pages or more, two at least."""
    p = table(spark, d, "odl_paragraphs", "document_id", "page_index", "text").where(F.col("document_id").isNotNull() & F.col("text").isNotNull())
    n = p.groupBy("document_id").agg(F.countDistinct("page_index").alias("pages")).where("pages >= 2")
    by = source_numbers(spark, d).groupBy("document_id", "number").agg(F.count(F.lit(1)).alias("n_pages"))
    return by.join(n, "document_id").where(F.col("n_pages") >= F.greatest(F.lit(2), F.floor(F.col("pages") * 0.5))).select("document_id", "number", "n_pages")


_MISSING = f"SELECT s.* FROM ({_PAGE_NUMBERS}) s ANTI JOIN ({_OUT_NUMBERS}) o USING (document_id, page_index, number) ANTI JOIN ({SQL['agg01_recurring']}) r USING (document_id, number) SEMI JOIN (SELECT DISTINCT document_id, page_index FROM page_outcomes WHERE markdown IS NOT NULL) g USING (document_id, page_index)"


@query("set04_missing_numbers", _MISSING)
def set04_missing_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a page's source that neither recur nor appear in its output."""
    keys = ["document_id", "page_index", "number"]
    done = pages(spark, d).select("document_id", "page_index").distinct()
    left = source_numbers(spark, d).join(output_numbers(spark, d), keys, "left_anti")
    return left.join(agg01_recurring(spark, d).select("document_id", "number"), ["document_id", "number"], "left_anti").join(done, ["document_id", "page_index"], "left_semi").select(*keys)


@query(
    "jon10_top04_completeness",
    f"""SELECT document_id, page_index, CASE WHEN n = 13 THEN 'odl_dropped_number_truncated:' || CAST(total - 12 AS VARCHAR) ELSE 'odl_dropped_number:' || number END AS flag FROM (
      SELECT *, row_number() OVER (PARTITION BY document_id, page_index ORDER BY number) AS n, count(*) OVER (PARTITION BY document_id, page_index) AS total FROM ({_MISSING})) WHERE n <= 13""",
)
def jon10_top04_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Flags of dropped numbers in lexicographic order, at most 12 a page and a marker for the rest (the cap is the feature)."""
    w = Window.partitionBy("document_id", "page_index")
    got = set04_missing_numbers(spark, d).select("*", F.row_number().over(w.orderBy("number")).alias("n"), F.count(F.lit(1)).over(w).alias("total")).where("n <= 13")
    flag = F.when(F.col("n") == 13, F.concat(F.lit("odl_dropped_number_truncated:"), (F.col("total") - 12).cast("string"))).otherwise(F.concat(F.lit("odl_dropped_number:"), F.col("number")))
    return got.select("document_id", "page_index", flag.alias("flag"))


_CONT = f"SELECT DISTINCT b.tbl_id, a.tbl_id AS previous, a.page_index AS from_page, b.page_index AS to_page FROM {_TBL} b JOIN {_TBL} a ON a.document_id = b.document_id AND a.table_id = b.previous_table_id WHERE a.page_index <> b.page_index"


@query("jon13_continuations", _CONT)
def jon13_continuations(spark: SparkSession, d: str) -> DataFrame:
    """Tables that go on from a table of another page, by their link."""
    t = tables(spark, d)
    a = t.select("document_id", F.col("table_id").alias("previous_table_id"), F.col("tbl_id").alias("previous"), F.col("page_index").alias("from_page"))
    b = t.select("document_id", "previous_table_id", "tbl_id", F.col("page_index").alias("to_page"))
    return b.join(a, ["document_id", "previous_table_id"]).where(F.col("from_page") != F.col("to_page")).select("tbl_id", "previous", "from_page", "to_page").distinct()


@query(
    "jon14_chains",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT tbl_id AS id, previous AS prev FROM ({_CONT})),
    walk AS (SELECT id, prev AS head, 1 AS depth FROM e UNION SELECT w.id, e.prev, w.depth + 1 FROM walk w JOIN e ON w.head = e.id WHERE w.depth < 64)
    SELECT id AS tbl_id, arg_max(head, (depth, -head)) AS head, max(depth) AS depth FROM walk GROUP BY id""",
)
def jon14_chains(spark: SparkSession, d: str) -> DataFrame:
    """The head of each continued table's chain, by pointer doubling: a round halves what is left, so six reach depth 64."""
    hop = jon13_continuations(spark, d).groupBy(F.col("tbl_id").alias("id")).agg(F.min("previous").alias("head")).withColumn("depth", F.lit(1))
    for _ in range(6):
        nxt = hop.select(F.col("id").alias("head"), F.col("head").alias("further"), F.col("depth").alias("more"))
        hop = hop.join(nxt, "head", "left").select("id", F.coalesce("further", "head").alias("head"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
    return hop.withColumnRenamed("id", "tbl_id")


@query(
    "win08_page_groups",
    f"""WITH l AS (SELECT DISTINCT b.document_id, b.page_index FROM {_TBL} b JOIN {_TBL} a ON a.document_id = b.document_id AND a.table_id = b.previous_table_id AND a.page_index = b.page_index - 1),
    p AS (SELECT DISTINCT document_id, page_index FROM page_outcomes WHERE document_id IS NOT NULL),
    s AS (SELECT p.*, CASE WHEN l.page_index IS NULL OR lag(p.page_index) OVER w IS DISTINCT FROM p.page_index - 1 THEN 1 ELSE 0 END AS fresh FROM p LEFT JOIN l USING (document_id, page_index) WINDOW w AS (PARTITION BY p.document_id ORDER BY p.page_index))
    SELECT document_id, page_index, sum(fresh) OVER (PARTITION BY document_id ORDER BY page_index ROWS UNBOUNDED PRECEDING) AS grp FROM s""",
)
def win08_page_groups(spark: SparkSession, d: str) -> DataFrame:
    """Runs of pages whose tables go on from one to the next."""
    t = tables(spark, d)
    a = t.select("document_id", F.col("table_id").alias("previous_table_id"), (F.col("page_index") + 1).alias("page_index")).distinct()
    linked = t.select("document_id", "page_index", "previous_table_id").join(a, ["document_id", "previous_table_id", "page_index"], "left_semi").select("document_id", "page_index").distinct().withColumn("linked", F.lit(1))
    w = Window.partitionBy("document_id").orderBy("page_index")
    p = pages_all(spark, d).join(linked, ["document_id", "page_index"], "left")
    fresh = F.when(F.col("linked").isNull() | ~F.coalesce(F.lag("page_index").over(w) == F.col("page_index") - 1, F.lit(False)), 1).otherwise(0)
    return p.withColumn("fresh", fresh).select("document_id", "page_index", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("grp"))


def pages_all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_outcomes", "document_id", "page_index").where(F.col("document_id").isNotNull())


@query("jon12_pages_with_meta", "SELECT DISTINCT p.out_id, p.route, m.source_id, m.run_mode FROM page_outcomes p JOIN docmeta m USING (document_id)")
def jon12_pages_with_meta(spark: SparkSession, d: str) -> DataFrame:
    """Pages with the provenance of their document."""
    return table(spark, d, "page_outcomes", "out_id", "document_id", "route").join(table(spark, d, "docmeta", "document_id", "source_id", "run_mode"), "document_id").select("out_id", "route", "source_id", "run_mode").distinct()


@query("jon17_cost_quality", "SELECT n.provider, avg(n.confidence) AS quality, coalesce(avg(p.latency), 0) AS cost FROM (SELECT DISTINCT np_id, document_id, page_index, provider, confidence FROM normalized_pages) n LEFT JOIN (SELECT document_id, page_index, max(latency_ms) AS latency FROM page_outcomes GROUP BY 1, 2) p USING (document_id, page_index) GROUP BY n.provider")
def jon17_cost_quality(spark: SparkSession, d: str) -> DataFrame:
    """Mean quality and cost of each provider; a missing cost counts for nothing."""
    n = table(spark, d, "normalized_pages", "np_id", "document_id", "page_index", "provider", "confidence")
    p = spark.read.parquet(f"{d}/page_outcomes.parquet").groupBy("document_id", "page_index").agg(F.max("latency_ms").alias("latency"))
    return n.join(p, ["document_id", "page_index"], "left").groupBy("provider").agg(F.avg("confidence").alias("quality"), F.coalesce(F.avg("latency"), F.lit(0.0)).alias("cost"))


@query("top08_pareto", f"WITH q AS (SELECT * FROM ({SQL['jon17_cost_quality']}) WHERE quality IS NOT NULL) SELECT provider, quality, cost FROM q WHERE NOT EXISTS (SELECT 1 FROM q o WHERE o.quality >= q.quality AND o.cost <= q.cost AND (o.quality > q.quality OR o.cost < q.cost))")
def top08_pareto(spark: SparkSession, d: str) -> DataFrame:
    """Providers that no other beats in quality and cost; equals both stay, unknown quality never counts. One sort and a running best, not all pairs."""
    q = jon17_cost_quality(spark, d).where(F.col("quality").isNotNull())
    by_cost = q.groupBy("cost").agg(F.max("quality").alias("best"))
    before = F.max("best").over(Window.orderBy("cost").rowsBetween(Window.unboundedPreceding, -1))  # one row per provider: a handful
    keep = by_cost.withColumn("before", before).where(F.col("before").isNull() | (F.col("best") > F.col("before"))).select("cost", F.col("best").alias("quality"))
    return q.join(keep, ["cost", "quality"], "left_semi").select("provider", "quality", "cost")


@query("flt25_new_documents", "SELECT DISTINCT document_id FROM docmeta ANTI JOIN (SELECT DISTINCT document_id FROM page_outcomes) USING (document_id) WHERE document_id IS NOT NULL")
def flt25_new_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents without an output: what an idempotent run would still do."""
    m = table(spark, d, "docmeta", "document_id").where(F.col("document_id").isNotNull())
    return m.join(table(spark, d, "page_outcomes", "document_id"), "document_id", "left_anti")


@query("flt24_catalog", "SELECT DISTINCT m.source_id, m.document_id, m.external_id, p.n_flags FROM docmeta m JOIN (SELECT document_id, sum(len(flags)) AS n_flags FROM (SELECT DISTINCT out_id, document_id, flags FROM page_outcomes) GROUP BY 1) p USING (document_id) WHERE n_flags > 0 AND m.source_id IS NOT NULL")
def flt24_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Flagged documents of the catalogue."""
    p = table(spark, d, "page_outcomes", "out_id", "document_id", "flags").groupBy("document_id").agg(F.sum(F.size("flags").cast("bigint")).alias("n_flags")).where("n_flags > 0")
    return table(spark, d, "docmeta", "source_id", "document_id", "external_id").where(F.col("source_id").isNotNull()).join(p, "document_id").select("source_id", "document_id", "external_id", "n_flags").distinct()


# ---- aggregations ---------------------------------------------------------------------------------------------

_KEYED = rf"""SELECT DISTINCT document_id, page_index, regexp_replace(lower({strip_sql('line')}), '\p{{Nd}}+', '#', 'g') AS key FROM {_LINES} WHERE document_id IS NOT NULL AND {strip_sql('line')} <> '' AND NOT regexp_matches({strip_sql('line')}, '^(?:\||>|!\[|<|```|~~~|#{{3,}})')"""


@query("agg02_furniture", f"SELECT document_id, key, count(*) AS n_pages FROM ({_KEYED}) GROUP BY 1, 2 HAVING count(*) >= 2")
def agg02_furniture(spark: SparkSession, d: str) -> DataFrame:
    """Lines that recur on two pages or more of a document, page numbers masked."""
    s = text.strip("line")
    kept = lines(spark, d).where(F.col("document_id").isNotNull() & (s != "") & ~s.rlike(r"^(?:\||>|!\[|<|```|~~~|#{3,})"))
    keyed = kept.select("document_id", "page_index", F.regexp_replace(F.lower(s), r"\p{Nd}+", "#").alias("key")).distinct()
    return keyed.groupBy("document_id", "key").agg(F.count(F.lit(1)).alias("n_pages")).where("n_pages >= 2")


_VOTE = rf"""SELECT DISTINCT document_id, page_index, CAST({strip_sql('text')} AS INTEGER) AS value FROM odl_paragraphs WHERE document_id IS NOT NULL AND regexp_matches({strip_sql('text')}, '^[0-9]{{1,4}}$')"""


@query("agg06_page_offset", f"SELECT document_id, k, votes, votes >= 3 AS supported FROM (SELECT document_id, value - page_index AS k, count(*) AS votes FROM ({_VOTE}) GROUP BY 1, 2)")
def agg06_page_offset(spark: SparkSession, d: str) -> DataFrame:
    """Votes for the offset of printed page numbers."""
    t = text.strip("text")
    p = table(spark, d, "odl_paragraphs", "document_id", "page_index", "text").where(F.col("document_id").isNotNull() & t.rlike("^[0-9]{1,4}$"))
    one = p.select("document_id", "page_index", t.cast("int").alias("value")).distinct()
    got = one.groupBy("document_id", (F.col("value") - F.col("page_index")).alias("k")).agg(F.count(F.lit(1)).alias("votes"))
    return got.withColumn("supported", F.col("votes") >= 3)


@query("agg07_printed_map", f"SELECT document_id, value AS printed, min(page_index) AS page_index FROM ({_VOTE}) GROUP BY 1, 2")
def agg07_printed_map(spark: SparkSession, d: str) -> DataFrame:
    """Printed page number to the first page that bears it."""
    t = text.strip("text")
    p = table(spark, d, "odl_paragraphs", "document_id", "page_index", "text").where(F.col("document_id").isNotNull() & t.rlike("^[0-9]{1,4}$"))
    return p.groupBy("document_id", t.cast("int").alias("printed")).agg(F.min("page_index").alias("page_index"))


@query("agg08_flags", "SELECT split_part(flag, ':', 1) AS flag, count(*) AS n FROM (SELECT out_id, unnest(flags) AS flag FROM (SELECT DISTINCT out_id, flags FROM page_outcomes)) GROUP BY 1")
def agg08_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags counted by what stands before the colon."""
    f = table(spark, d, "page_outcomes", "out_id", "flags").select(F.explode("flags").alias("flag"))
    return f.groupBy(F.substring_index("flag", ":", 1).alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query("agg09_ratios", "SELECT route, count(*) AS pages, CASE WHEN count(*) = 0 THEN NULL ELSE count(*) FILTER (WHERE used_vlm) / count(*) END AS vlm_share FROM (SELECT DISTINCT out_id, route, used_vlm FROM page_outcomes) GROUP BY route")
def agg09_ratios(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "page_outcomes", "out_id", "route", "used_vlm")
    return p.groupBy("route").agg(F.count(F.lit(1)).alias("pages"), (F.sum(F.col("used_vlm").cast("int")) / F.count(F.lit(1))).alias("vlm_share"))


@query(
    "agg10_left_edge",
    """SELECT document_id, arg_min(edge, (-n, edge)) AS edge, max(n) AS n FROM (SELECT document_id, CAST(round_even(bbox[1], 0) AS INTEGER) AS edge, count(*) AS n FROM (SELECT DISTINCT para_id, document_id, bbox FROM odl_paragraphs WHERE bbox IS NOT NULL AND document_id IS NOT NULL) GROUP BY 1, 2) GROUP BY 1""",
)
def agg10_left_edge(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent left edge of a document's blocks; of equals the leftmost."""
    p = table(spark, d, "odl_paragraphs", "para_id", "document_id", "bbox").where(F.col("bbox").isNotNull() & F.col("document_id").isNotNull())
    n = p.groupBy("document_id", F.rint(F.col("bbox")[0]).cast("int").alias("edge")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("document_id").agg(F.min_by("edge", F.struct(-F.col("n"), "edge")).alias("edge"), F.max("n").alias("n"))


#: Words that mark a row of totals.
TOTALS = ("합계", "총계", "소계", "총합", "계", "total", "subtotal", "sum")
_IS_TOTAL = "(" + " OR ".join(f"contains(lower(coalesce(cells[r][1], '')), '{w}')" for w in TOTALS) + ")"
_CELLS = "SELECT tbl_id, cells, unnest(range(1, len(cells) + 1)) AS r FROM (SELECT DISTINCT tbl_id, cells FROM odl_tables WHERE len(cells) > 0)"


@query(
    "agg12_column_sums",
    f"""WITH t AS (SELECT tbl_id, any_value(cells) AS cells, min(r) FILTER (WHERE {_IS_TOTAL}) AS total_row FROM ({_CELLS}) GROUP BY tbl_id, cells),
    v AS (SELECT tbl_id, cells, total_row, unnest(range(2, len(cells[total_row]) + 1)) AS c FROM t WHERE total_row > 1),
    x AS (SELECT tbl_id, c - 1 AS col, try_cast(replace(trim(cells[total_row][c]), ',', '') AS DOUBLE) AS total, list_filter(list_transform(cells[1:total_row - 1], lambda r: try_cast(replace(trim(r[c]), ',', '') AS DOUBLE)), lambda y: y IS NOT NULL) AS items FROM v)
    SELECT DISTINCT tbl_id, col, total, round(list_sum(items), 4) AS line_sum, abs(list_sum(items) - total) <= greatest(abs(total) * 1e-3, 0.5) AS agrees FROM x WHERE total IS NOT NULL AND len(items) >= 2""",
)
def agg12_column_sums(spark: SparkSession, d: str) -> DataFrame:
    """Columns of tables with a row of totals: whether the items above it add up."""
    number = lambda x: F.replace(F.trim(x), F.lit(","), F.lit("")).try_cast("double")
    total = lambda x: F.lower(F.coalesce(x, F.lit(""))).rlike("|".join(TOTALS))
    t = table(spark, d, "odl_tables", "tbl_id", "cells").where(F.size("cells") > 0)
    t = t.withColumn("first", F.array_position(F.transform("cells", lambda r: total(F.get(r, F.lit(0)))), F.lit(True)).cast("int")).where("first > 1")
    c = t.select("tbl_id", "cells", "first", F.explode(F.sequence(F.lit(1), F.size(F.col("cells")[F.col("first") - 1]) - 1)).alias("col"))
    items = F.filter(F.transform(F.expr("slice(cells, 1, first - 1)"), lambda r: number(F.get(r, F.col("col")))), lambda y: y.isNotNull())
    x = c.select("tbl_id", "col", number(F.get(F.get("cells", F.col("first") - 1), F.col("col"))).alias("total"), items.alias("items")).where(F.col("total").isNotNull() & (F.size("items") >= 2))
    s = F.aggregate("items", F.lit(0.0), lambda a, b: a + b)
    return x.select("tbl_id", "col", "total", F.round(s, 4).alias("line_sum"), (F.abs(s - F.col("total")) <= F.greatest(F.abs("total") * 1e-3, F.lit(0.5))).alias("agrees")).distinct()


@query("agg15_catalog_counts", "SELECT document_id, count(*) AS pages, count(*) FILTER (WHERE used_vlm) AS vlm_pages, count(*) FILTER (WHERE len(flags) > 0) AS flagged, sum(coalesce(len(flags), 0)) AS n_flags FROM (SELECT DISTINCT out_id, document_id, used_vlm, flags FROM page_outcomes) WHERE document_id IS NOT NULL GROUP BY 1")
def agg15_catalog_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pages and flags of each document."""
    p = table(spark, d, "page_outcomes", "out_id", "document_id", "used_vlm", "flags").where(F.col("document_id").isNotNull())
    n = F.when(F.col("flags").isNull(), 0).otherwise(F.size("flags"))
    return p.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if("used_vlm").alias("vlm_pages"), F.count_if(n > 0).alias("flagged"), F.sum(n).alias("n_flags"))


@query("agg16_latency", "SELECT route, count(*) AS n, avg(latency_ms) AS mean, min(latency_ms) AS least, max(latency_ms) AS most FROM (SELECT DISTINCT out_id, route, latency_ms FROM page_outcomes) GROUP BY route")
def agg16_latency(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_outcomes", "out_id", "route", "latency_ms").groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("mean"), F.min("latency_ms").alias("least"), F.max("latency_ms").alias("most"))


@query("agg18_run_summary", "SELECT m.run_mode, count(DISTINCT m.document_id) AS documents, count(DISTINCT p.out_id) AS pages FROM docmeta m LEFT JOIN page_outcomes p USING (document_id) WHERE m.document_id IS NOT NULL GROUP BY 1")
def agg18_run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Documents and pages of each mode: pages are counted by document first, so the join meets one row per document."""
    m = table(spark, d, "docmeta", "document_id", "run_mode").where(F.col("document_id").isNotNull())
    p = table(spark, d, "page_outcomes", "document_id", "out_id").groupBy("document_id").agg(F.countDistinct("out_id").alias("n"))
    return m.join(p, "document_id", "left").groupBy("run_mode").agg(F.count("document_id").alias("documents"), F.sum(F.coalesce("n", F.lit(0))).alias("pages"))


# ---- windows, order, samples ----------------------------------------------------------------------------------


@query("win23_clusters", "SELECT para_id, sum(fresh) OVER (PARTITION BY document_id, page_index ORDER BY x, para_id ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT para_id, document_id, page_index, bbox[1] AS x, CASE WHEN bbox[1] - lag(bbox[1]) OVER (PARTITION BY document_id, page_index ORDER BY bbox[1], para_id) <= 3.0 THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT para_id, document_id, page_index, bbox FROM odl_paragraphs WHERE bbox IS NOT NULL AND document_id IS NOT NULL))")
def win23_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Left edges of a page in chained clusters: a gap of more than 3 begins a new one."""
    p = table(spark, d, "odl_paragraphs", "para_id", "document_id", "page_index", "bbox").where(F.col("bbox").isNotNull() & F.col("document_id").isNotNull()).withColumn("x", F.col("bbox")[0])
    w = Window.partitionBy("document_id", "page_index").orderBy("x", "para_id")
    fresh = F.when(F.col("x") - F.lag("x").over(w) <= 3.0, 0).otherwise(1)
    return p.withColumn("fresh", fresh).select("para_id", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cluster"))


@query("top01_reading_order", "SELECT para_id, row_number() OVER (PARTITION BY document_id ORDER BY page_index, ord, para_id) AS pos FROM (SELECT DISTINCT para_id, document_id, page_index, ord FROM odl_paragraphs WHERE document_id IS NOT NULL)")
def top01_reading_order(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "odl_paragraphs", "para_id", "document_id", "page_index", "ord").where(F.col("document_id").isNotNull())
    return p.select("para_id", F.row_number().over(Window.partitionBy("document_id").orderBy("page_index", "ord", "para_id")).alias("pos"))


@query("top02_even_sample", "SELECT DISTINCT document_id, CAST(round_even(i * (n - 1) / 4.0, 0) AS INTEGER) AS page FROM (SELECT document_id, max(n_pages) AS n FROM docmeta WHERE document_id IS NOT NULL GROUP BY 1), (SELECT unnest(range(0, 5)) AS i) WHERE n >= 1")
def top02_even_sample(spark: SparkSession, d: str) -> DataFrame:
    """Five evenly spaced pages of each document, first and last included (the sample is the feature)."""
    n = spark.read.parquet(f"{d}/docmeta.parquet").where(F.col("document_id").isNotNull()).groupBy("document_id").agg(F.max("n_pages").alias("n")).where("n >= 1")
    at = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.rint(i * (F.col("n") - 1) / 4.0).cast("int"))
    return n.select("document_id", F.explode(F.array_distinct(at)).alias("page"))


@query("top07_ranking", "SELECT provider, quality, rank() OVER (ORDER BY quality DESC NULLS LAST) AS place FROM (" + SQL["jon17_cost_quality"] + ")")
def top07_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Providers by quality: one row per provider, so a single sorted partition is a handful of rows."""
    q = jon17_cost_quality(spark, d)
    return q.select("provider", "quality", F.rank().over(Window.orderBy(F.col("quality").desc_nulls_last())).alias("place"))


# ---- sets and scores ------------------------------------------------------------------------------------------

_TS = "list_sort(list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[0-9a-z\\x{{AC00}}-\\x{{D7A3}}]+')))"
_SRC_TEXT = "SELECT document_id, page_index, string_agg(text, chr(10) ORDER BY ord, para_id, text) AS src FROM (SELECT DISTINCT para_id, document_id, page_index, ord, text FROM odl_paragraphs WHERE text IS NOT NULL AND document_id IS NOT NULL) GROUP BY 1, 2"
_PAIR = f"SELECT out_id, {_TS.format('markdown')} AS a, {_TS.format('src')} AS b, markdown, src FROM {PAGES} JOIN ({_SRC_TEXT}) USING (document_id, page_index)"
_SHARED = "len(list_intersect(a, b))"


def source_text(spark: SparkSession, d: str) -> DataFrame:
    """(document_id, page_index, src): the text of each page, its paragraphs in order."""
    p = table(spark, d, "odl_paragraphs", "para_id", "document_id", "page_index", "ord", "text").where(F.col("document_id").isNotNull() & F.col("text").isNotNull())
    got = p.groupBy("document_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("ord", "para_id", "text"))).alias("x"))
    return got.select("document_id", "page_index", F.array_join(F.col("x.text"), "\n").alias("src"))


def page_pairs(spark: SparkSession, d: str) -> DataFrame:
    got = pages(spark, d).join(source_text(spark, d), ["document_id", "page_index"])
    return got.select("out_id", "markdown", "src", text.token_set("markdown").alias("a"), text.token_set("src").alias("b"))


@query("set01_divergence", f"SELECT out_id, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0 ELSE 1 - {_SHARED} / len(list_distinct(list_concat(a, b))) END AS divergence FROM ({_PAIR})")
def set01_divergence(spark: SparkSession, d: str) -> DataFrame:
    """How far a page's output is from its source, by word sets."""
    return page_pairs(spark, d).select("out_id", text.jaccard_distance(F.col("a"), F.col("b")).alias("divergence"))


@query("set02_f1", f"SELECT out_id, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN {_SHARED} = 0 THEN 0.0 ELSE 2 * {_SHARED} / (len(a) + len(b)) END AS f1 FROM ({_PAIR})")
def set02_f1(spark: SparkSession, d: str) -> DataFrame:
    return page_pairs(spark, d).select("out_id", text.set_f1(F.col("a"), F.col("b")).alias("f1"))


_NS = r"list_distinct(list_transform(regexp_extract_all({0}, '\p{{Nd}}[\p{{Nd}},.]{{3,}}'), lambda x: replace(x, ',', '')))"


@query(
    "set03_number_recall",
    f"""SELECT out_id, CASE WHEN len(g) = 0 THEN 1.0 ELSE len(list_intersect(o, g)) / len(g) END AS recall, CASE WHEN len(o) = 0 THEN 0.0 ELSE (len(o) - len(list_intersect(o, g))) / len(o) END AS hallucination
    FROM (SELECT out_id, {_NS.format('markdown')} AS o, {_NS.format('src')} AS g FROM ({_PAIR}))""",
)
def set03_number_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of the source's long numbers in the output, and of the output's numbers that the source lacks."""
    nums = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\p{Nd}[\p{Nd},.]{3,}"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(""))))
    p = page_pairs(spark, d).select("out_id", nums("markdown").alias("o"), nums("src").alias("g")).withColumn("n", F.size(F.array_intersect("o", "g")))
    recall = F.when(F.size("g") == 0, 1.0).otherwise(F.col("n") / F.size("g"))
    return p.select("out_id", recall.alias("recall"), F.when(F.size("o") == 0, 0.0).otherwise((F.size("o") - F.col("n")) / F.size("o")).alias("hallucination"))


@query("set05_registry", "SELECT 'paragraph' AS kind, para_id AS id, document_id, page_index FROM odl_paragraphs WHERE document_id IS NOT NULL UNION SELECT 'table', tbl_id, document_id, page_index FROM odl_tables WHERE document_id IS NOT NULL UNION SELECT 'caption', cap_id, document_id, page_index FROM odl_captions WHERE document_id IS NOT NULL")
def set05_registry(spark: SparkSession, d: str) -> DataFrame:
    """Every node of every document in one stream."""
    part = lambda kind, t, i: table(spark, d, t, i, "document_id", "page_index").where(F.col("document_id").isNotNull()).select(F.lit(kind).alias("kind"), F.col(i).alias("id"), "document_id", "page_index")
    return part("paragraph", "odl_paragraphs", "para_id").union(part("table", "odl_tables", "tbl_id")).union(part("caption", "odl_captions", "cap_id"))


@query("set06_references", f"SELECT para_id, string_agg(CAST(tbl_id AS VARCHAR), ',' ORDER BY tbl_id) AS refs FROM ({SQL['jon04_cross_references']}) GROUP BY 1")
def set06_references(spark: SparkSession, d: str) -> DataFrame:
    """The distinct tables each paragraph names, sorted."""
    got = jon04_cross_references(spark, d).groupBy("para_id").agg(F.array_sort(F.collect_set("tbl_id")).alias("r"))
    return got.select("para_id", F.array_join(F.transform("r", lambda x: x.cast("string")), ",").alias("refs"))


@query("agg14_diagnosis", f"SELECT m.source_id, avg(CASE WHEN length(markdown) < 20 THEN 1.0 ELSE 0.0 END) AS scan_fraction, count(*) AS pages FROM {PAGES} p JOIN (SELECT DISTINCT document_id, source_id FROM docmeta WHERE source_id IS NOT NULL) m USING (document_id) GROUP BY 1")
def agg14_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """The share of pages without text of each source."""
    m = table(spark, d, "docmeta", "document_id", "source_id").where(F.col("source_id").isNotNull())
    return pages(spark, d).join(m, "document_id").groupBy("source_id").agg(F.avg(F.when(F.length("markdown") < 20, 1.0).otherwise(0.0)).alias("scan_fraction"), F.count(F.lit(1)).alias("pages"))


@query("flt22_mode", f"SELECT source_id, CASE WHEN scan_fraction >= 0.25 THEN 'det_vlm' WHEN d >= 0.30 THEN 'det_vlm' ELSE 'deterministic' END AS mode, CASE WHEN scan_fraction >= 0.25 THEN 0.9 WHEN d >= 0.30 THEN 0.75 ELSE 0.7 END AS confidence FROM ({SQL['agg14_diagnosis']}) LEFT JOIN (SELECT m.source_id, avg(divergence) AS d FROM ({SQL['set01_divergence']}) JOIN (SELECT DISTINCT out_id, document_id FROM page_outcomes) USING (out_id) JOIN (SELECT DISTINCT document_id, source_id FROM docmeta WHERE source_id IS NOT NULL) m USING (document_id) GROUP BY 1) USING (source_id)")
def flt22_mode(spark: SparkSession, d: str) -> DataFrame:
    """The mode recommended for each source, with a confidence."""
    m = table(spark, d, "docmeta", "document_id", "source_id").where(F.col("source_id").isNotNull())
    div = set01_divergence(spark, d).join(table(spark, d, "page_outcomes", "out_id", "document_id"), "out_id").join(m, "document_id").groupBy("source_id").agg(F.avg("divergence").alias("d"))
    got = agg14_diagnosis(spark, d).join(div, "source_id", "left")
    scan, far = F.col("scan_fraction") >= 0.25, F.col("d") >= 0.30
    return got.select("source_id", F.when(scan | far, "det_vlm").otherwise("deterministic").alias("mode"), F.when(scan, 0.9).when(far, 0.75).otherwise(0.7).alias("confidence"))


@query("top05_nearest", "SELECT cap_id, tbl_id FROM (" + SQL["jon01_nearest"] + ")")
def top05_nearest(spark: SparkSession, d: str) -> DataFrame:
    return jon01_nearest(spark, d).select("cap_id", "tbl_id")


@query("latest_records", "SELECT document_id, arg_max(n_pages, (ingested_at, n_pages)) AS n_pages FROM docmeta WHERE document_id IS NOT NULL GROUP BY 1")
def latest_records(spark: SparkSession, d: str) -> DataFrame:
    """The page count of each document's last ingested record."""
    return latest(spark, d, "docmeta", "document_id", "n_pages")


@query("chunk_budget", f"SELECT document_id, sum({tokens_sql('text')}) AS tokens FROM (SELECT DISTINCT para_id, document_id, text FROM odl_paragraphs WHERE text IS NOT NULL AND document_id IS NOT NULL) GROUP BY 1")
def chunk_budget(spark: SparkSession, d: str) -> DataFrame:
    """Estimated tokens of each document."""
    p = table(spark, d, "odl_paragraphs", "para_id", "document_id", "text").where(F.col("text").isNotNull() & F.col("document_id").isNotNull())
    return p.groupBy("document_id").agg(F.sum(text.approx_tokens("text")).alias("tokens"))

