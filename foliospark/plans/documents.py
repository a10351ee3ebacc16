"""Queries that read documents in order: tags, zones, headings, sections, assembled pages, chunks and the graph."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbering, text
from ..operators import chunks, rules
from ..sources.tables import latest, table
from . import relations
from .scalars import _MD, W, _quote, strip_sql
from .scalars import SQL as SCALAR_SQL

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_NODES = "(SELECT DISTINCT para_id, document_id, page_index, kind, text, font_size, heading_level, odl_level, ord FROM odl_paragraphs WHERE document_id IS NOT NULL AND text IS NOT NULL)"
_SIGNALS = f"""(SELECT *, (page_index + 1) / (max(page_index) OVER (PARTITION BY document_id) + 1) AS page_frac,
  CASE WHEN font_size IS NOT NULL THEN (rank() OVER (PARTITION BY document_id ORDER BY font_size NULLS FIRST) - 1 - count(*) FILTER (WHERE font_size IS NULL) OVER (PARTITION BY document_id)) / count(font_size) OVER (PARTITION BY document_id) END AS font_rank FROM {_NODES})"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Paragraph nodes with the fields rules see; texts that are null are no nodes."""
    p = table(spark, d, "odl_paragraphs", "para_id", "document_id", "page_index", "kind", "text", "font_size", "heading_level", "odl_level", "ord")
    return rules.signals(p.where(F.col("document_id").isNotNull() & F.col("text").isNotNull()))


@query("win01_font_rank", f"SELECT para_id, font_size, font_rank FROM {_SIGNALS} WHERE font_size IS NOT NULL")
def win01_font_rank(spark: SparkSession, d: str) -> DataFrame:
    """The share of a document's sized nodes in a smaller font."""
    return nodes(spark, d).where(F.col("font_size").isNotNull()).select("para_id", "font_size", "font_rank")


@query("flt08_signals", f"SELECT para_id, page_index, page_frac, kind AS odl_type, odl_level AS odl_role, CAST(heading_level AS VARCHAR) AS odl_heading_level FROM {_SIGNALS}")
def flt08_signals(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select("para_id", "page_index", "page_frac", "odl_type", "odl_role", F.col("odl_heading_level").cast("string").alias("odl_heading_level"))


def _rule_sql(clause: dict) -> str:
    """The oracle's reading of a rule's condition."""
    parts = []
    names = {"odl_type": "kind", "odl_role": "odl_level", "odl_heading_level": "heading_level"}
    for key, v in clause.items():
        if key in ("all", "any"):
            parts.append("(" + (" AND " if key == "all" else " OR ").join(_rule_sql(x) for x in v) + ")")
        elif key == "text_degenerate":
            parts.append(f"para_id IN ({SCALAR_SQL['flt05_degenerate']})")
        elif key == "text_matches":
            parts.append(f"regexp_matches(text, {_quote(v)})")
        elif key == "classify_numbering":
            parts.append(f"para_id IN (SELECT para_id FROM ({SCALAR_SQL['scl03_numbering']}))")
        else:
            for op, x in v.items():
                c = names.get(key, key)
                parts.append(f"coalesce({c} IN ({', '.join(map(repr, x))}), false)" if op == "in" else f"coalesce({c} {dict(eq='=', gte='>=', lte='<=')[op]} {x!r}, false)")
    return " AND ".join(parts) or "true"


def _tag_sql() -> str:
    axis = lambda name, value: "coalesce(" + ", ".join(f"CASE WHEN {_rule_sql(r['when'])} THEN '{value(r)}' END" for r in rules.DEFAULT_RULES if name in r["then"]) + ")"
    return f"SELECT *, {axis('type', lambda r: r['then']['type'])} AS type, {axis('type', lambda r: r['id'])} AS type_rule, {axis('zone', lambda r: r['then']['zone'])} AS own_zone, {axis('zone', lambda r: r['id'])} AS zone_rule FROM {_SIGNALS}"


_ZONED = f"""SELECT *, coalesce(own_zone, last_value(CASE WHEN zone_rule IN ('references-zone', 'appendix-zone') THEN own_zone END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page_index, ord, para_id ROWS UNBOUNDED PRECEDING), 'body') AS zone FROM ({_tag_sql()})"""


def zoned(spark: SparkSession, d: str) -> DataFrame:
    return rules.carried(rules.tagged(nodes(spark, d)))


@query("flt01_04_tags", f"SELECT para_id, type, type_rule, own_zone FROM ({_tag_sql()})")
def flt01_04_tags(spark: SparkSession, d: str) -> DataFrame:
    """The type and own zone of each node, by the first rule of each axis."""
    return rules.tagged(nodes(spark, d)).select("para_id", "type", "type_rule", "own_zone")


@query("win02_zones", f"SELECT para_id, zone FROM ({_ZONED})")
def win02_zones(spark: SparkSession, d: str) -> DataFrame:
    return zoned(spark, d).select("para_id", "zone")


@query("agg03_zone_summary", f"SELECT document_id, zone, min(page_index) AS first_page, count(DISTINCT page_index) AS pages FROM ({_ZONED}) GROUP BY 1, 2")
def agg03_zone_summary(spark: SparkSession, d: str) -> DataFrame:
    return zoned(spark, d).groupBy("document_id", "zone").agg(F.min("page_index").alias("first_page"), F.countDistinct("page_index").alias("pages"))


@query("agg04_page_zone", f"SELECT document_id, page_index, arg_min(zone, (-n, first)) AS zone FROM (SELECT document_id, page_index, zone, count(*) AS n, min((ord, para_id)) AS first FROM ({_ZONED}) GROUP BY 1, 2, 3) GROUP BY 1, 2")
def agg04_page_zone(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent zone of each page; of equals the one met first."""
    n = zoned(spark, d).groupBy("document_id", "page_index", "zone").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "para_id")).alias("first"))
    return n.groupBy("document_id", "page_index").agg(F.min_by("zone", F.struct(-F.col("n"), "first")).alias("zone"))


# ---- headings and sections ------------------------------------------------------------------------------------


@query("win04_levels")
def win04_levels(spark: SparkSession, d: str) -> DataFrame:
    """(para_id, level): levels of numbered headings, learned document by document. Only headings go into the sequential step."""
    h = rules.tagged(nodes(spark, d)).where((F.col("type") == "heading") & ~text.list_veto("text", "kind") & ~text.prose_veto("text")).withColumn("n", numbering.classify("text")).where(F.col("n").isNotNull())
    h = h.select("document_id", "para_id", "page_index", "ord", "n.style", "n.tier", "n.depth")

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["page_index"], r["ord"], r["para_id"]))
        return pa.table({"para_id": pa.array([r["para_id"] for r in rows], pa.int64()), "level": pa.array(numbering.levels([(r["style"], r["tier"], r["depth"]) for r in rows]), pa.int32())})

    return h.groupBy("document_id").applyInArrow(run, "para_id bigint, level int")


_LV = "least(6, greatest(1, CAST(coalesce(heading_level, 1) AS INTEGER)))"
_POS = f"SELECT para_id, document_id, page_index, text, kind, row_number() OVER (PARTITION BY document_id ORDER BY page_index, ord, para_id) AS pos, CASE WHEN kind = 'heading' THEN {_LV} END AS level FROM {_NODES}"
_SECTIONS = f"""SELECT para_id, document_id, pos, level, greatest({', '.join(f"CASE WHEN level > {k} THEN coalesce(max(CASE WHEN level = {k} THEN pos END) OVER w, 0) ELSE 0 END" for k in range(1, 6))}) AS parent FROM ({_POS}) WHERE level IS NOT NULL WINDOW w AS (PARTITION BY document_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def positions(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("kind") == "heading", F.least(F.lit(6), F.greatest(F.lit(1), F.coalesce("heading_level", F.lit(1)).cast("int"))))
    w = Window.partitionBy("document_id").orderBy("page_index", "ord", "para_id")
    p = table(spark, d, "odl_paragraphs", "para_id", "document_id", "page_index", "kind", "text", "font_size", "heading_level", "odl_level", "ord").where(F.col("document_id").isNotNull() & F.col("text").isNotNull())
    return p.select("*", F.row_number().over(w).alias("pos"), level.alias("level"))


def sections(spark: SparkSession, d: str) -> DataFrame:
    """Headings with the position of their parent: the nearest one before of a smaller level, 0 for none."""
    w = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col("level") > k, F.coalesce(F.max(F.when(F.col("level") == k, F.col("pos"))).over(w), F.lit(0))).otherwise(0) for k in range(1, 6)]
    return positions(spark, d).where(F.col("level").isNotNull()).withColumn("parent", F.greatest(*last))


@query("win06_sections", f"SELECT para_id, level, pos, parent FROM ({_SECTIONS})")
def win06_sections(spark: SparkSession, d: str) -> DataFrame:
    return sections(spark, d).select("para_id", "level", "pos", "parent")


@query(
    "win07_breadcrumbs",
    f"""WITH RECURSIVE s AS (SELECT x.*, p.text FROM ({_SECTIONS}) x JOIN ({_POS}) p USING (document_id, pos)),
    up AS (SELECT document_id, pos AS leaf, parent, text AS crumb FROM s UNION ALL SELECT up.document_id, up.leaf, s.parent, s.text || ' > ' || up.crumb FROM up JOIN s ON s.document_id = up.document_id AND s.pos = up.parent)
    SELECT document_id, leaf AS pos, crumb FROM up WHERE parent = 0""",
)
def win07_breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    """The headings from the outermost to each heading. Levels are six, so five joins reach the top."""
    s = sections(spark, d).select("document_id", "pos", "parent", "text")
    out = s.select("document_id", "pos", "parent", F.col("text").alias("crumb"))
    up = s.select("document_id", F.col("pos").alias("parent"), F.col("parent").alias("next"), F.col("text").alias("above"))
    for _ in range(5):
        joined = out.join(up, ["document_id", "parent"], "left")
        out = joined.select("document_id", "pos", F.coalesce("next", F.lit(0)).alias("parent"), F.when(F.col("above").isNotNull(), F.concat("above", F.lit(" > "), "crumb")).otherwise(F.col("crumb")).alias("crumb"))
    return out.select("document_id", "pos", "crumb")


_MEMBER = f"SELECT para_id, coalesce(max(CASE WHEN level IS NOT NULL THEN pos END) OVER (PARTITION BY document_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS section FROM ({_POS})"


@query("jon20_membership", _MEMBER)
def jon20_membership(spark: SparkSession, d: str) -> DataFrame:
    """The section each node belongs to: the position of the last heading at or before it, 0 for none."""
    w = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return positions(spark, d).select("para_id", F.coalesce(F.max(F.when(F.col("level").isNotNull(), F.col("pos"))).over(w), F.lit(0)).alias("section"))


@query(
    "win09_units",
    f"""SELECT para_id, sum(fresh) OVER (PARTITION BY document_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS unit FROM (
      SELECT *, CASE WHEN lag(k) OVER (PARTITION BY document_id ORDER BY pos) = k THEN 0 ELSE 1 END AS fresh FROM (
        SELECT para_id, document_id, pos, CASE WHEN section > 0 THEN 's' || section ELSE 'p' || page_index END AS k FROM ({_POS}) JOIN ({_MEMBER}) USING (para_id)))""",
)
def win09_units(spark: SparkSession, d: str) -> DataFrame:
    p = positions(spark, d).join(jon20_membership(spark, d), "para_id").withColumn("section", F.nullif("section", F.lit(0)))
    return chunks.units(p).select("para_id", "unit")


# ---- assembled pages and chunks -------------------------------------------------------------------------------


@query(
    "asm03_pages",
    f"""SELECT document_id, page_index, string_agg(t, chr(10) || chr(10) ORDER BY ord, kind, id, t) AS markdown FROM (
      SELECT document_id, page_index, ord, 'p' AS kind, para_id AS id, text AS t FROM {_NODES} UNION
      SELECT document_id, page_index, ord, 't', tbl_id, {_MD} FROM odl_tables WHERE len(cells) > 0 AND document_id IS NOT NULL) GROUP BY 1, 2""",
)
def asm03_pages(spark: SparkSession, d: str) -> DataFrame:
    """Each page as Markdown: its paragraphs and tables in order, a blank line between them."""
    p = table(spark, d, "odl_paragraphs", "document_id", "page_index", "ord", "para_id", "text").where(F.col("document_id").isNotNull() & F.col("text").isNotNull())
    p = p.select("document_id", "page_index", "ord", F.lit("p").alias("kind"), F.col("para_id").alias("id"), F.col("text").alias("t"))
    t = table(spark, d, "odl_tables", "document_id", "page_index", "ord", "tbl_id", "cells").where(F.col("document_id").isNotNull() & (F.size("cells") > 0))
    t = t.select("document_id", "page_index", "ord", F.lit("t").alias("kind"), F.col("tbl_id").alias("id"), text.table_markdown("cells").alias("t"))
    got = p.union(t).distinct().groupBy("document_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("ord", "kind", "id", "t"))).alias("x"))
    return got.select("document_id", "page_index", F.array_join(F.col("x.t"), "\n\n").alias("markdown"))


def chunk_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs and tables in reading order with section, zone and the policy of their document."""
    z = zoned(spark, d).select("document_id", "page_index", "ord", F.lit(0).alias("k"), F.col("para_id").alias("id"), "type", "zone", "text", (F.col("kind") == "heading").alias("head"))
    t = table(spark, d, "odl_tables", "document_id", "page_index", "ord", "tbl_id", "label").where(F.col("document_id").isNotNull())
    label = F.concat(F.lit("["), F.coalesce(F.nullif("label", F.lit("")), F.lit("Table")), F.lit("]"))
    t = t.select("document_id", "page_index", "ord", F.lit(1).alias("k"), F.col("tbl_id").alias("id"), F.lit("table").alias("type"), F.lit(None).cast("string").alias("zone"), label.alias("text"), F.lit(False).alias("head"))
    w = Window.partitionBy("document_id").orderBy("page_index", "ord", "k", "id", "text")
    got = z.where("zone <> 'furniture'").union(t).withColumn("pos", F.row_number().over(w).cast("bigint"))
    got = got.withColumn("section", F.max(F.when(F.col("head"), F.col("pos"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    profile = latest(spark, d, "docmeta", "document_id", "profile_id").select("document_id", F.coalesce("profile_id", F.lit("default")).alias("profile_id"))
    policy = table(spark, d, "chunk_policy", "profile_id", "child_tokens", "keep_atomic")
    known = profile.join(policy, "profile_id", "left").select("document_id", "child_tokens", "keep_atomic")
    one = policy.where("profile_id = 'default'").first()
    child, keep = (one.child_tokens, list(one.keep_atomic)) if one else (384, ["table", "figure", "equation"])
    out = got.join(known, "document_id", "left")
    return out.withColumns({"child_tokens": F.coalesce("child_tokens", F.lit(child)), "keep_atomic": F.coalesce("keep_atomic", F.array(*map(F.lit, keep)))})


@query("asm07_chunks")
def asm07_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The child chunks of every document with their links."""
    return chunks.linked(chunks.children(chunks.units(chunk_nodes(spark, d)).select("document_id", "unit", "pos", "page_index", "type", "zone", "text", "child_tokens", "keep_atomic")))


@query("asm07_parents")
def asm07_parents(spark: SparkSession, d: str) -> DataFrame:
    """The parent chunks: one row per unit, with its size and pages."""
    u = chunks.units(chunk_nodes(spark, d))
    got = u.groupBy("document_id", "unit").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("x"), F.min("page_index").alias("first_page"), F.max("page_index").alias("last_page"), F.max("section").alias("section"))
    shown = F.array_join(F.filter(F.col("x.text"), lambda t: t != ""), "\n")
    got = got.select("document_id", "unit", F.when(F.col("section").isNotNull(), "section").otherwise("page").alias("structural_type"), "first_page", "last_page", shown.alias("display_text"))
    return got.withColumn("token_count", text.approx_tokens("display_text"))


# ---- graph ----------------------------------------------------------------------------------------------------

_EDGES = f"""SELECT 'mentions' AS kind, 'p' || para_id AS src, 't' || tbl_id AS dst FROM ({relations.SQL['jon04_cross_references']})
  UNION SELECT 'captions', 'c' || cap_id, 't' || tbl_id FROM ({relations.SQL['jon01_linked']})
  UNION SELECT 'continues', 't' || tbl_id, 't' || previous FROM ({relations.SQL['jon13_continuations']})
  UNION SELECT 'within', 's' || s.para_id, 's' || p.para_id FROM ({_SECTIONS}) s JOIN ({_POS}) p ON p.document_id = s.document_id AND p.pos = s.parent"""


@query("kgr01_edges", _EDGES)
def kgr01_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the document graph."""
    edge = lambda df, kind, a, src, b, dst: df.select(F.lit(kind).alias("kind"), F.concat(F.lit(a), F.col(src).cast("string")).alias("src"), F.concat(F.lit(b), F.col(dst).cast("string")).alias("dst"))
    s = sections(spark, d)
    above = s.select("document_id", F.col("pos").alias("parent"), F.col("para_id").alias("above"))
    parts = [
        edge(relations.jon04_cross_references(spark, d), "mentions", "p", "para_id", "t", "tbl_id"),
        edge(relations.jon01_linked(spark, d), "captions", "c", "cap_id", "t", "tbl_id"),
        edge(relations.jon13_continuations(spark, d), "continues", "t", "tbl_id", "t", "previous"),
        edge(s.join(above, ["document_id", "parent"]), "within", "s", "para_id", "s", "above"),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).distinct()


@query("kgr06_counts", f"SELECT kind, count(*) AS edges, count(DISTINCT src) AS sources FROM ({_EDGES}) GROUP BY 1")
def kgr06_counts(spark: SparkSession, d: str) -> DataFrame:
    return kgr01_edges(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("sources"))


_HTML = "'<table>' || array_to_string(list_transform(cells, lambda r: '<tr>' || array_to_string(list_transform(r, lambda x: '<td>' || replace(replace(replace(coalesce(x, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td>'), '') || '</tr>'), '') || '</table>'"


@query("evl05_table_html", f"SELECT DISTINCT tbl_id, {_HTML} AS html FROM odl_tables WHERE len(cells) > 0")
def evl05_table_html(spark: SparkSession, d: str) -> DataFrame:
    """Cells as table HTML."""
    esc = lambda x: F.replace(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda x: F.concat(F.lit("<td>"), esc(x), F.lit("</td>"))), ""), F.lit("</tr>"))
    t = table(spark, d, "odl_tables", "tbl_id", "cells").where(F.size("cells") > 0)
    return t.select("tbl_id", F.concat(F.lit("<table>"), F.array_join(F.transform("cells", row), ""), F.lit("</table>")).alias("html")).distinct()


@query("snk08_ledger", "SELECT DISTINCT out_id, document_id, page_index, route, used_vlm, coalesce(length(markdown), 0) AS chars, coalesce(len(flags), 0) AS n_flags FROM page_outcomes")
def snk08_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The ledger: one line per page outcome, without its text."""
    p = table(spark, d, "page_outcomes", "out_id", "document_id", "page_index", "route", "used_vlm", "markdown", "flags")
    return p.select("out_id", "document_id", "page_index", "route", "used_vlm", F.coalesce(F.length("markdown"), F.lit(0)).alias("chars"), F.when(F.col("flags").isNull(), 0).otherwise(F.size("flags")).alias("n_flags")).distinct()


@query("scl23_titles", f"SELECT document_id, coalesce(any_value(m.title), arg_min(n.text, (n.page_index, n.ord, n.para_id))) AS title FROM (SELECT document_id, max(producer['title']) AS title FROM docmeta WHERE document_id IS NOT NULL GROUP BY 1) m JOIN {_NODES} n USING (document_id) WHERE n.kind = 'heading' AND {strip_sql('n.text')} <> '' GROUP BY 1")
def scl23_titles(spark: SparkSession, d: str) -> DataFrame:
    """A document's title: its producer's, else its first heading."""
    m = spark.read.parquet(f"{d}/docmeta.parquet").where(F.col("document_id").isNotNull()).groupBy("document_id").agg(F.max(F.col("producer")["title"]).alias("title"))
    p = table(spark, d, "odl_paragraphs", "para_id", "document_id", "page_index", "kind", "text", "ord").where((F.col("kind") == "heading") & (text.strip("text") != ""))
    first = p.groupBy("document_id").agg(F.min_by("text", F.struct("page_index", "ord", "para_id")).alias("head"))
    return m.join(first, "document_id").select("document_id", F.coalesce("title", "head").alias("title"))
