"""Queries of page layout, caption repair, samples by structure and document scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..sources.tables import table
from . import documents, relations
from .relations import _SRC_TEXT, _TBL, captions, output_numbers, source_numbers, source_text, tables
from .scalars import _LINES, PAGES, W, _quote, lines, pages, paras, strip_sql

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

_BLOCKS = "(SELECT DISTINCT para_id, document_id, page_index, bbox FROM odl_paragraphs WHERE bbox IS NOT NULL AND document_id IS NOT NULL)"


@query(
    "jon03_contained",
    f"""SELECT para_id, max(tbl_id) AS tbl_id FROM {_BLOCKS} b JOIN {_TBL} t USING (document_id, page_index)
    WHERE (b.bbox[1] + b.bbox[3]) / 2 BETWEEN t.bbox[1] AND t.bbox[3] AND (b.bbox[2] + b.bbox[4]) / 2 BETWEEN t.bbox[2] AND t.bbox[4] GROUP BY para_id""",
)
def jon03_contained(spark: SparkSession, d: str) -> DataFrame:
    """Blocks whose centre lies in a table's box, edges included; of several the last."""
    b = table(spark, d, "odl_paragraphs", "para_id", "document_id", "page_index", "bbox").where(F.col("bbox").isNotNull() & F.col("document_id").isNotNull())
    t = tables(spark, d).select("document_id", "page_index", "tbl_id", F.col("bbox").alias("tb"))
    x, y = (F.col("bbox")[0] + F.col("bbox")[2]) / 2, (F.col("bbox")[1] + F.col("bbox")[3]) / 2
    inside = x.between(F.col("tb")[0], F.col("tb")[2]) & y.between(F.col("tb")[1], F.col("tb")[3])
    return b.join(t, ["document_id", "page_index"]).where(inside).groupBy("para_id").agg(F.max("tbl_id").alias("tbl_id"))


def _normed(c: str) -> str:
    bare = f"regexp_replace(regexp_replace({c}, {_quote(f'^[#>*{W}]+')}, ''), '[*_`#>]', '', 'g')"
    return "lower(" + strip_sql(f"regexp_replace({bare}, {_quote(f'[{W}]+')}, ' ', 'g')") + ")"


_HEAD10 = f"SELECT DISTINCT document_id, page_index, substr({_normed('text')}, 1, 10) AS head FROM odl_paragraphs WHERE text IS NOT NULL AND document_id IS NOT NULL AND length({_normed('text')}) >= 10"


@query("jon08_absent_lines", f"SELECT out_id, line_no FROM (SELECT out_id, line_no, document_id, page_index, substr({_normed('line')}, 1, 10) AS head FROM {_LINES} WHERE document_id IS NOT NULL AND length({_normed('line')}) >= 10) ANTI JOIN ({_HEAD10}) USING (document_id, page_index, head)")
def jon08_absent_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an output that share no first ten characters with a block of their page: an equi-join on that prefix."""
    n = text.norm_block("line")
    mine = lines(spark, d).where(F.col("document_id").isNotNull() & (F.length(n) >= 10)).select("out_id", "line_no", "document_id", "page_index", F.substring(n, 1, 10).alias("head"))
    p = table(spark, d, "odl_paragraphs", "document_id", "page_index", "text").where(F.col("text").isNotNull() & F.col("document_id").isNotNull()).withColumn("n", text.norm_block("text")).where("length(n) >= 10")
    heads = p.select("document_id", "page_index", F.substring("n", 1, 10).alias("head")).distinct()
    return mine.join(heads, ["document_id", "page_index", "head"], "left_anti").select("out_id", "line_no")


@query(
    "jon16_number_hits",
    f"""SELECT document_id, page_index, count(*) AS total, count(o.number) AS hits FROM ({relations._PAGE_NUMBERS}) s LEFT JOIN ({relations._OUT_NUMBERS}) o USING (document_id, page_index, number) GROUP BY 1, 2""",
)
def jon16_number_hits(spark: SparkSession, d: str) -> DataFrame:
    """How many of a page's source numbers its output holds."""
    o = output_numbers(spark, d).withColumn("hit", F.lit(1))
    got = source_numbers(spark, d).join(o, ["document_id", "page_index", "number"], "left")
    return got.groupBy("document_id", "page_index").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("hits"))


_LINE_LABEL = rf"regexp_extract(regexp_replace(line, '^[*#> |-]+', ''), {_quote(text.TABLE_LABEL)}, 1)"


@query(
    "jon19_backfill",
    f"""SELECT t.tbl_id, l.label FROM (SELECT DISTINCT tbl_id, document_id, page_index FROM {_TBL} WHERE label IS NULL) t JOIN (
      SELECT document_id, page_index, arg_min(label, (out_id, line_no)) AS label FROM (SELECT *, {_LINE_LABEL} AS label FROM {_LINES}) WHERE label <> '' AND document_id IS NOT NULL GROUP BY 1, 2) l USING (document_id, page_index)""",
)
def jon19_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Unlabelled tables with the first table label in their page's output."""
    label = F.regexp_extract(F.regexp_replace("line", r"^[*#> |-]+", ""), text.TABLE_LABEL, 1)
    first = lines(spark, d).withColumn("label", label).where((F.col("label") != "") & F.col("document_id").isNotNull()).groupBy("document_id", "page_index").agg(F.min_by("label", F.struct("out_id", "line_no")).alias("label"))
    bare = tables(spark, d).where(F.col("label").isNull()).select("tbl_id", "document_id", "page_index").distinct()
    return bare.join(first, ["document_id", "page_index"]).select("tbl_id", "label")


@query("jon21_reading_nodes", f"SELECT para_id, row_number() OVER (PARTITION BY document_id ORDER BY page_index, ord, para_id) AS pos FROM ({documents._ZONED}) WHERE zone <> 'furniture'")
def jon21_reading_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that stay in reading order: all but furniture."""
    w = Window.partitionBy("document_id").orderBy("page_index", "ord", "para_id")
    return documents.zoned(spark, d).where("zone <> 'furniture'").select("para_id", F.row_number().over(w).alias("pos"))


def _title(c: str) -> str:
    return "lower(" + strip_sql(f"regexp_replace({c}, {_quote(text.NUMBER_PREFIX)}, '')") + ")"


_TOC = f"SELECT DISTINCT document_id, {_title(f'regexp_extract(text, {_quote(text.LEADER)}, 1)')} AS title FROM odl_paragraphs WHERE document_id IS NOT NULL AND text IS NOT NULL AND regexp_matches(text, {_quote(text.LEADER)})"


@query("jon05_authority", f"SELECT DISTINCT para_id FROM (SELECT para_id, document_id, {_title('text')} AS title FROM odl_paragraphs WHERE kind = 'heading' AND text IS NOT NULL AND document_id IS NOT NULL) h SEMI JOIN ({_TOC}) USING (document_id, title) WHERE title <> ''")
def jon05_authority(spark: SparkSession, d: str) -> DataFrame:
    """Headings whose title, without numbering, stands in the document's contents."""
    title = lambda c: F.lower(text.strip(F.regexp_replace(c, text.NUMBER_PREFIX, "")))
    p = table(spark, d, "odl_paragraphs", "para_id", "document_id", "kind", "text").where(F.col("text").isNotNull() & F.col("document_id").isNotNull())
    toc = p.where(F.col("text").rlike(text.LEADER)).select("document_id", title(F.regexp_extract("text", text.LEADER, 1)).alias("title")).distinct()
    return p.where("kind = 'heading'").select("para_id", "document_id", title("text").alias("title")).where("title <> ''").join(toc, ["document_id", "title"], "left_semi").select("para_id").distinct()


# ---- aggregations, windows, samples ---------------------------------------------------------------------------


@query("agg11_marginal_columns", f"WITH e AS ({relations.SQL['agg10_left_edge']}) SELECT document_id, page_index, count(*) AS blocks FROM {_BLOCKS} b JOIN e USING (document_id) WHERE b.bbox[1] < e.edge - 10 GROUP BY 1, 2 HAVING count(*) >= 2")
def agg11_marginal_columns(spark: SparkSession, d: str) -> DataFrame:
    """Pages with two blocks or more left of the body's edge by more than 10."""
    b = table(spark, d, "odl_paragraphs", "para_id", "document_id", "page_index", "bbox").where(F.col("bbox").isNotNull() & F.col("document_id").isNotNull())
    got = b.join(relations.agg10_left_edge(spark, d).select("document_id", "edge"), "document_id").where(F.col("bbox")[0] < F.col("edge") - 10)
    return got.groupBy("document_id", "page_index").agg(F.count(F.lit(1)).alias("blocks")).where("blocks >= 2")


@query("agg13_ratio_guard", "SELECT DISTINCT document_id, n_pages, pages, abs(pages - n_pages) <= greatest(1, abs(n_pages) * 5e-4) AS agrees FROM (SELECT document_id, max(n_pages) AS n_pages FROM docmeta WHERE document_id IS NOT NULL GROUP BY 1) JOIN (SELECT document_id, count(DISTINCT page_index) AS pages FROM page_outcomes GROUP BY 1) USING (document_id) WHERE n_pages IS NOT NULL")
def agg13_ratio_guard(spark: SparkSession, d: str) -> DataFrame:
    """Whether the pages of a document agree with its declared count, within the guard's tolerance."""
    m = spark.read.parquet(f"{d}/docmeta.parquet").where(F.col("document_id").isNotNull()).groupBy("document_id").agg(F.max("n_pages").alias("n_pages")).where("n_pages IS NOT NULL")
    p = table(spark, d, "page_outcomes", "document_id", "page_index").groupBy("document_id").agg(F.count("page_index").alias("pages"))
    return m.join(p, "document_id").select("document_id", "n_pages", "pages", (F.abs(F.col("pages") - F.col("n_pages")) <= F.greatest(F.lit(1.0), F.abs("n_pages") * 5e-4)).alias("agrees"))


@query("agg19_page_means", f"SELECT document_id, round(avg(f1), 3) AS f1, count(*) AS pages FROM ({relations.SQL['set02_f1']}) JOIN (SELECT DISTINCT out_id, document_id FROM page_outcomes WHERE document_id IS NOT NULL) USING (out_id) GROUP BY 1")
def agg19_page_means(spark: SparkSession, d: str) -> DataFrame:
    """The mean of its pages' scores for each document."""
    p = table(spark, d, "page_outcomes", "out_id", "document_id").where(F.col("document_id").isNotNull())
    return relations.set02_f1(spark, d).join(p, "out_id").groupBy("document_id").agg(F.round(F.avg("f1"), 3).alias("f1"), F.count(F.lit(1)).alias("pages"))


_WEAVE = f"""SELECT DISTINCT 0 AS k, 'p' || para_id AS node, document_id, page_index, ord AS place FROM odl_paragraphs WHERE document_id IS NOT NULL
  UNION SELECT 1, 't' || tbl_id, document_id, page_index, ord FROM odl_tables WHERE document_id IS NOT NULL
  UNION SELECT 2, 'c' || c.cap_id, t.document_id, t.page_index, min(t.ord) FROM (SELECT DISTINCT cap_id, document_id, linked_content_id FROM odl_captions) c JOIN {_TBL} t ON t.document_id = c.document_id AND t.table_id = c.linked_content_id AND t.tbl_id = (SELECT min(u.tbl_id) FROM {_TBL} u WHERE u.document_id = c.document_id AND u.table_id = c.linked_content_id) GROUP BY ALL"""


@query("win13_weave", f"SELECT node, row_number() OVER (PARTITION BY document_id ORDER BY page_index, place, k, node) AS pos FROM ({_WEAVE})")
def win13_weave(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs and tables in reading order, each linked caption right after its table."""
    node = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string")).alias("node")
    p = table(spark, d, "odl_paragraphs", "para_id", "document_id", "page_index", "ord").where(F.col("document_id").isNotNull()).select(F.lit(0).alias("k"), node("p", "para_id"), "document_id", "page_index", F.col("ord").alias("at"))
    t = table(spark, d, "odl_tables", "tbl_id", "document_id", "page_index", "ord").where(F.col("document_id").isNotNull()).select(F.lit(1).alias("k"), node("t", "tbl_id"), "document_id", "page_index", F.col("ord").alias("at"))
    host = tables(spark, d).where(F.col("table_id").isNotNull()).groupBy("document_id", F.col("table_id").alias("linked_content_id")).agg(F.min(F.struct("tbl_id", "page_index", "ord")).alias("h"))
    c = captions(spark, d).select("cap_id", "document_id", "linked_content_id").distinct().join(host, ["document_id", "linked_content_id"]).select(F.lit(2).alias("k"), node("c", "cap_id"), "document_id", F.col("h.page_index").alias("page_index"), F.col("h.ord").alias("at"))
    every = p.union(t).union(c).distinct()
    return every.select("node", F.row_number().over(Window.partitionBy("document_id").orderBy("page_index", "at", "k", "node")).alias("pos"))


_WITH_TABLES = "SELECT document_id, page_index, row_number() OVER (PARTITION BY document_id ORDER BY page_index) AS n FROM (SELECT DISTINCT document_id, page_index FROM odl_tables WHERE document_id IS NOT NULL) t ANTI JOIN (SELECT document_id, page AS page_index FROM even) USING (document_id, page_index)"


@query("top03_structure_sample", f"WITH even AS ({relations.SQL['top02_even_sample']}) SELECT document_id, page FROM even UNION SELECT document_id, page_index FROM ({_WITH_TABLES}) WHERE n <= 2")
def top03_structure_sample(spark: SparkSession, d: str) -> DataFrame:
    """The even sample and the first two other pages with tables (the sample is the feature)."""
    even = relations.top02_even_sample(spark, d)
    more = tables(spark, d).select("document_id", "page_index").distinct().join(even.withColumnRenamed("page", "page_index"), ["document_id", "page_index"], "left_anti")
    more = more.withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy("page_index"))).where("n <= 2").select("document_id", F.col("page_index").alias("page"))
    return even.union(more).distinct()


# ---- scalars of nodes -----------------------------------------------------------------------------------------


@query("scl08_node_ids", "SELECT DISTINCT para_id, 'p' || (page_index + 1) || '_' || coalesce(CAST(element_id AS VARCHAR), 'b' || ord) AS node_id FROM odl_paragraphs")
def scl08_node_ids(spark: SparkSession, d: str) -> DataFrame:
    """Node identifiers by page and element, by order where there is no element."""
    p = table(spark, d, "odl_paragraphs", "para_id", "page_index", "element_id", "ord")
    return p.select("para_id", F.concat(F.lit("p"), (F.col("page_index") + 1).cast("string"), F.lit("_"), F.coalesce(F.col("element_id").cast("string"), F.concat(F.lit("b"), F.col("ord").cast("string")))).alias("node_id")).distinct()


@query("scl06_boxes", "SELECT DISTINCT para_id, bbox[3] - bbox[1] AS width, bbox[4] - bbox[2] AS height FROM odl_paragraphs WHERE len(bbox) >= 4")
def scl06_boxes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "odl_paragraphs", "para_id", "bbox").where(F.size("bbox") >= 4)
    return p.select("para_id", (F.col("bbox")[2] - F.col("bbox")[0]).alias("width"), (F.col("bbox")[3] - F.col("bbox")[1]).alias("height")).distinct()


@query("flt15_tiny_boxes", "SELECT para_id FROM (" + SQL["scl06_boxes"] + ") WHERE width * height < 900 OR least(width, height) < 12")
def flt15_tiny_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of less than 900 in area or 12 on a side."""
    return scl06_boxes(spark, d).where((F.col("width") * F.col("height") < 900) | (F.least("width", "height") < 12)).select("para_id")


@query("scl15_node_text", f"SELECT DISTINCT tbl_id, '[' || coalesce(nullif(label, ''), 'Table') || ']' AS shown FROM {_TBL}")
def scl15_node_text(spark: SparkSession, d: str) -> DataFrame:
    """What a chunk shows for a table."""
    return tables(spark, d).select("tbl_id", F.concat(F.lit("["), F.coalesce(F.nullif("label", F.lit("")), F.lit("Table")), F.lit("]")).alias("shown")).distinct()


_ESC = r"regexp_replace(markdown, '(^|[^\\$])\$(\p{Nd})', '\1\\$\2', 'g')"


@query("scl17_currency", f"SELECT out_id, {_ESC} AS md FROM {PAGES}")
def scl17_currency(spark: SparkSession, d: str) -> DataFrame:
    """Dollar signs before numbers escaped."""
    return pages(spark, d).select("out_id", F.regexp_replace("markdown", r"(^|[^\\$])\$(\p{Nd})", "$1\\\\\\$$2").alias("md"))


@query("scl18_urls", r"SELECT para_id, regexp_matches(text, 'https?://\S+$') AS ends_with_url, regexp_matches(text, '^[A-Za-z0-9]+[./]\S*') AS goes_on FROM (SELECT DISTINCT para_id, text FROM odl_paragraphs WHERE text IS NOT NULL)")
def scl18_urls(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that end in an address, and blocks that may go on with one."""
    return paras(spark, d).select("para_id", F.col("text").rlike(r"https?://\S+\z").alias("ends_with_url"), F.col("text").rlike(r"^[A-Za-z0-9]+[./]\S*").alias("goes_on"))


@query("scl24_figure_source", "SELECT DISTINCT np_id, CASE WHEN image_description IS NOT NULL THEN 'vlm' ELSE 'none' END AS source FROM normalized_pages")
def scl24_figure_source(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "normalized_pages", "np_id", "image_description")
    return p.select("np_id", F.when(F.col("image_description").isNotNull(), "vlm").otherwise("none").alias("source")).distinct()


@query("scl28_grounded_prompt", f"SELECT document_id, page_index, 'Text layer:' || chr(10) || substr(src, 1, 6000) AS prompt FROM ({_SRC_TEXT}) WHERE {strip_sql('src')} <> ''")
def scl28_grounded_prompt(spark: SparkSession, d: str) -> DataFrame:
    """The prompt that grounds a transcription in the text layer, 6,000 characters of it (the limit is the feature)."""
    p = source_text(spark, d).where(text.strip("src") != "")
    return p.select("document_id", "page_index", F.concat(F.lit("Text layer:\n"), F.substring("src", 1, 6000)).alias("prompt"))


# ---- scores ---------------------------------------------------------------------------------------------------

_DOC_SETS = r"""SELECT document_id, list_distinct(flatten(list(a))) AS a, list_distinct(flatten(list(b))) AS b FROM (SELECT out_id, a, b FROM ({pair})) JOIN (SELECT DISTINCT out_id, document_id FROM page_outcomes WHERE document_id IS NOT NULL) USING (out_id) GROUP BY 1""".replace("{pair}", relations._PAIR)


@query(
    "evl01_documents",
    f"""SELECT document_id, CASE WHEN len(a) = 0 THEN 0.0 ELSE n / len(a) END AS token_precision, CASE WHEN len(b) = 0 THEN 0.0 ELSE n / len(b) END AS token_recall, len(b) AS words
    FROM (SELECT *, len(list_intersect(a, b)) AS n FROM ({_DOC_SETS}))""",
)
def evl01_documents(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of each document's word set. Words are joined, not collected, so no document is held in one row."""
    keys = ["document_id", "w"]
    docs = table(spark, d, "page_outcomes", "out_id", "document_id").where(F.col("document_id").isNotNull())
    pairs = relations.page_pairs(spark, d).join(docs, "out_id")
    out = pairs.select("document_id", F.explode("a").alias("w")).distinct().withColumn("o", F.lit(1))
    src = pairs.select("document_id", F.explode("b").alias("w")).distinct().withColumn("s", F.lit(1))
    n = out.join(src, keys, "full").groupBy("document_id").agg(F.count("o").alias("o"), F.count("s").alias("s"), F.sum(F.when(F.col("o").isNotNull() & F.col("s").isNotNull(), 1).otherwise(0)).alias("n"))
    n = pairs.select("document_id").distinct().join(n, "document_id", "left").na.fill(0, ["o", "s", "n"])
    return n.select("document_id", F.when(F.col("o") == 0, 0.0).otherwise(F.col("n") / F.col("o")).alias("token_precision"), F.when(F.col("s") == 0, 0.0).otherwise(F.col("n") / F.col("s")).alias("token_recall"), F.col("s").alias("words"))


@query("evl03_verdict", f"SELECT route, avg(recall) AS recall, avg(hallucination) AS hallucination, avg(hallucination) <= 0.15 AS admissible FROM ({relations.SQL['set03_number_recall']}) JOIN (SELECT DISTINCT out_id, route FROM page_outcomes) USING (out_id) GROUP BY 1")
def evl03_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Number recall of each route, and whether what it makes up stays below the veto."""
    r = table(spark, d, "page_outcomes", "out_id", "route")
    got = relations.set03_number_recall(spark, d).join(r, "out_id").groupBy("route").agg(F.avg("recall").alias("recall"), F.avg("hallucination").alias("hallucination"))
    return got.withColumn("admissible", F.col("hallucination") <= 0.15)
