"""Queries of the scalar functions and predicates, each over its whole table, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbering, text
from ..sources.tables import table

QUERIES = {}
SQL = {}
W, N = text.WS, text.NUMBER


def _quote(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, {_quote(f'^[{W}]+|[{W}]+$')}, '', 'g')"


def tokens_sql(c: str) -> str:
    return f"(length(regexp_replace({c}, {_quote(f'[^{text.CJK}]')}, '', 'g')) + CAST(round_even(len(regexp_extract_all({c}, {_quote(f'[^{W}{text.CJK}]+')})) * 1.3, 0) AS INTEGER))"


def numbers_sql(c: str) -> str:
    return f"list_transform(regexp_extract_all({c}, {_quote(N)}), lambda x: replace(x, ',', ''))"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


PARA = "(SELECT DISTINCT para_id, text FROM odl_paragraphs WHERE text IS NOT NULL)"


def paras(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "odl_paragraphs", "para_id", *cols, "text").where(F.col("text").isNotNull())


@query("scl01_02_numbers", f"SELECT para_id, generate_subscripts(n, 1) AS pos, unnest(n) AS number FROM (SELECT para_id, {numbers_sql('text')} AS n FROM {PARA})")
def scl01_02_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of each paragraph in reading order, without thousands commas."""
    return paras(spark, d).select("para_id", F.posexplode(text.numbers("text")).alias("p", "number")).select("para_id", (F.col("p") + 1).alias("pos"), "number")


@query("scl02_least", f"SELECT para_id, len(list_filter({numbers_sql('text')}, lambda x: coalesce(try_cast(x AS DOUBLE) >= 1000, false))) AS n FROM {PARA}")
def scl02_least(spark: SparkSession, d: str) -> DataFrame:
    """How many numbers of 1000 or more each paragraph holds."""
    return paras(spark, d).select("para_id", F.size(text.numbers_from("text", 1000)).alias("n"))


def _numbering_sql() -> str:
    t = f"regexp_replace(text, {_quote(f'^[{W}]+')}, '')"
    digits = f"regexp_extract(t, {_quote(numbering.DECIMAL)}, 1)"
    depth = f"(length(regexp_replace({digits}, '[^.．]', '', 'g')) - length(regexp_replace({digits}, '[^．]', '', 'g')) + 1)"
    style = rank = tier = "CASE"
    name = "CASE"
    for p, r, n, s, k in numbering.PREFIXES:
        when = f" WHEN regexp_matches(t, {_quote(p)}) THEN "
        dec = s == "decimal"
        style += when + (f"'decimal:' || {depth}" if dec else f"'{s}'")
        rank += when + (f"least({depth} + 1, 4)" if dec else str(r))
        name += when + (f"CASE WHEN {depth} = 1 THEN 'section' WHEN {depth} = 2 THEN 'subsection' ELSE 'item' END" if dec else f"'{n}'")
        tier += when + str(k)
    return f"SELECT * FROM (SELECT para_id, {rank} END AS rank, {name} END AS name, {style} END AS style, {tier} END AS tier FROM (SELECT para_id, {t} AS t FROM {PARA})) WHERE style IS NOT NULL"


@query("scl03_numbering", _numbering_sql())
def scl03_numbering(spark: SparkSession, d: str) -> DataFrame:
    """The numbering of every paragraph that begins with one."""
    got = paras(spark, d).select("para_id", numbering.classify("text").alias("n")).where(F.col("n").isNotNull())
    return got.select("para_id", "n.rank", "n.name", "n.style", "n.tier")


_CLEAN = strip_sql(r"regexp_replace(regexp_replace(text, '[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}]', ' ', 'g'), ' {2,}', ' ', 'g')")


@query("scl04_clean", f"SELECT para_id, {_CLEAN} AS clean FROM {PARA}")
def scl04_clean(spark: SparkSession, d: str) -> DataFrame:
    return paras(spark, d).select("para_id", text.clean("text").alias("clean"))


@query(
    "scl05_labels",
    f"""SELECT cap_id, CASE WHEN t <> '' THEN 'table' ELSE 'figure' END AS kind, CASE WHEN t <> '' THEN t ELSE f END AS label FROM (
      SELECT DISTINCT cap_id, regexp_extract(x, {_quote(text.TABLE_LABEL)}, 1) AS t, regexp_extract(x, {_quote(text.FIGURE_LABEL)}, 1) AS f
      FROM (SELECT cap_id, {strip_sql('text')} AS x FROM odl_captions WHERE text IS NOT NULL)) WHERE t <> '' OR f <> ''""",
)
def scl05_labels(spark: SparkSession, d: str) -> DataFrame:
    """The label at the head of each caption."""
    c = table(spark, d, "odl_captions", "cap_id", "text").where(F.col("text").isNotNull()).withColumn("x", text.strip("text"))
    got = c.select("cap_id", F.regexp_extract("x", text.TABLE_LABEL, 1).alias("t"), F.regexp_extract("x", text.FIGURE_LABEL, 1).alias("f")).where("t <> '' OR f <> ''").distinct()
    return got.select("cap_id", F.when(F.col("t") != "", "table").otherwise("figure").alias("kind"), F.when(F.col("t") != "", F.col("t")).otherwise(F.col("f")).alias("label"))


_NORM = f"lower({strip_sql(f'''regexp_replace(regexp_replace(regexp_replace(text, {_quote(f'^[#>*{W}]+')}, ''), '[*_`#>]', '', 'g'), {_quote(f'[{W}]+')}, ' ', 'g')''')})"


@query("scl09_norm_block", f"SELECT para_id, {_NORM} AS norm FROM {PARA}")
def scl09_norm_block(spark: SparkSession, d: str) -> DataFrame:
    return paras(spark, d).select("para_id", text.norm_block("text").alias("norm"))


_KEY = strip_sql(r"regexp_replace(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}]+', ' ', 'g'), '\p{Nd}+', '#', 'g'), ' {2,}', ' ', 'g')")


@query("scl11_line_key", f"SELECT para_id, {_KEY} AS key FROM {PARA}")
def scl11_line_key(spark: SparkSession, d: str) -> DataFrame:
    return paras(spark, d).select("para_id", text.line_key("text").alias("key"))


@query("scl12_number_key", rf"SELECT para_id, regexp_replace(regexp_extract(text, {_quote(text.NUMBER_PREFIX)}), {_quote(f'[{W}]+')}, '', 'g') AS key FROM {PARA} WHERE regexp_matches(text, {_quote(text.NUMBER_PREFIX)})")
def scl12_number_key(spark: SparkSession, d: str) -> DataFrame:
    """The leading numbering token without white space."""
    got = paras(spark, d).where(F.col("text").rlike(text.NUMBER_PREFIX))
    return got.select("para_id", F.regexp_replace(F.regexp_extract("text", text.NUMBER_PREFIX, 0), rf"[{W}]+", "").alias("key"))


@query("scl13_cjk", f"SELECT para_id, regexp_matches(text, {_quote(f'[{text.CJK}]')}) AS cjk FROM {PARA}")
def scl13_cjk(spark: SparkSession, d: str) -> DataFrame:
    return paras(spark, d).select("para_id", F.col("text").rlike(f"[{text.CJK}]").alias("cjk"))


@query("scl14_tokens", f"SELECT para_id, {tokens_sql('text')} AS tokens FROM {PARA}")
def scl14_tokens(spark: SparkSession, d: str) -> DataFrame:
    return paras(spark, d).select("para_id", text.approx_tokens("text").alias("tokens"))


PAGES = "(SELECT DISTINCT out_id, document_id, page_index, markdown FROM page_outcomes WHERE markdown IS NOT NULL)"


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_outcomes", "out_id", "document_id", "page_index", "markdown").where(F.col("markdown").isNotNull())


@query("scl19_equations", rf"SELECT out_id, generate_subscripts(e, 1) AS pos, unnest(e) AS latex FROM (SELECT out_id, list_transform(regexp_extract_all(markdown, '(?s)\$\$(.+?)\$\$', 1), lambda x: {strip_sql('x')}) AS e FROM {PAGES})")
def scl19_equations(spark: SparkSession, d: str) -> DataFrame:
    """Display equations of each page."""
    got = pages(spark, d).select("out_id", F.posexplode(F.regexp_extract_all("markdown", F.lit(r"(?s)\$\$(.+?)\$\$"), F.lit(1))).alias("p", "e"))
    return got.select("out_id", (F.col("p") + 1).alias("pos"), text.strip("e").alias("latex"))


@query(
    "scl20_reference_marker",
    "SELECT para_id, coalesce(" + ", ".join(f"nullif(regexp_extract(text, {_quote(text.REFERENCE)}, {i}), '')" for i in (1, 2, 3, 4)) + f") AS marker FROM {PARA} WHERE regexp_matches(text, {_quote(text.REFERENCE)})",
)
def scl20_reference_marker(spark: SparkSession, d: str) -> DataFrame:
    return paras(spark, d).where(F.col("text").rlike(text.REFERENCE)).select("para_id", text.reference_marker("text").alias("marker"))


@query("scl21_contents", f"SELECT para_id, {strip_sql(f'regexp_extract(text, {_quote(text.LEADER)}, 1)')} AS title, regexp_extract(text, {_quote(text.LEADER)}, 2) AS page FROM {PARA} WHERE regexp_matches(text, {_quote(text.LEADER)})")
def scl21_contents(spark: SparkSession, d: str) -> DataFrame:
    """Contents lines: title and printed page."""
    got = paras(spark, d).where(F.col("text").rlike(text.LEADER))
    return got.select("para_id", text.strip(F.regexp_extract("text", text.LEADER, 1)).alias("title"), F.regexp_extract("text", text.LEADER, 2).alias("page"))


@query("scl25_content_id", "SELECT doc_id, sha256(text) AS sha, substr(sha256(text), 1, 16) AS id FROM documents WHERE text IS NOT NULL")
def scl25_content_id(spark: SparkSession, d: str) -> DataFrame:
    """Content hash and the identifier cut from it."""
    docs = table(spark, d, "documents", "doc_id", "text").where(F.col("text").isNotNull())
    return docs.select("doc_id", F.sha2("text", 256).alias("sha")).withColumn("id", F.substring("sha", 1, 16))


@query("scl26_meta", "SELECT DISTINCT document_id, substr(content_sha256, 1, 16) = document_id AS id_matches, coalesce(source_id, 'default') AS source_id, external_id, n_pages, run_mode, producer['title'] AS title FROM docmeta WHERE document_id IS NOT NULL")
def scl26_meta(spark: SparkSession, d: str) -> DataFrame:
    """Identity and provenance of each document."""
    m = spark.read.parquet(f"{d}/docmeta.parquet").where(F.col("document_id").isNotNull())
    return m.select("document_id", (F.substring("content_sha256", 1, 16) == F.col("document_id")).alias("id_matches"), F.coalesce("source_id", F.lit("default")).alias("source_id"), "external_id", "n_pages", "run_mode", F.col("producer")["title"].alias("title")).distinct()


_MD = """array_to_string(list_transform(range(1, len(cells) + 1), lambda i:
  '| ' || array_to_string(list_transform(cells[i], lambda x: replace(coalesce(x, ''), '|', '\\|')), ' | ') || ' |' || CASE WHEN i = 1 THEN chr(10) || '|' || repeat('---|', len(cells[1])) ELSE '' END), chr(10))"""


@query("scl27_table_markdown", f"SELECT DISTINCT tbl_id, {_MD} AS md FROM odl_tables WHERE len(cells) > 0")
def scl27_table_markdown(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "odl_tables", "tbl_id", "cells").where(F.size("cells") > 0)
    return t.select("tbl_id", text.table_markdown("cells").alias("md")).distinct()


_EVAL = f"lower({strip_sql(f'''regexp_replace(regexp_replace(regexp_replace(markdown, '<[a-zA-Z/][^>]*>', ' ', 'g'), '[#*_`|>~-]+', ' ', 'g'), {_quote(f'[{W}]+')}, ' ', 'g')''')})"


@query("scl29_evaluation_form", f"SELECT out_id, {_EVAL} AS form FROM {PAGES}")
def scl29_evaluation_form(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("out_id", text.evaluation_form("markdown").alias("form"))


_CANON = r"regexp_replace(regexp_replace(h, '(?i)<(/?)th\b', '<\1td', 'g'), '(?i)</?t(?:head|body|foot)\b[^>]*>', '', 'g')"


@query("scl30_canonical_tables", f"SELECT np_id, generate_subscripts(t, 1) AS pos, unnest(list_transform(t, lambda h: {_CANON})) AS html FROM (SELECT DISTINCT np_id, tables_html AS t FROM normalized_pages WHERE len(tables_html) > 0)")
def scl30_canonical_tables(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "normalized_pages", "np_id", "tables_html").where(F.size("tables_html") > 0)
    return t.select("np_id", F.posexplode("tables_html").alias("p", "h")).select("np_id", (F.col("p") + 1).alias("pos"), text.canonical_table("h").alias("html"))


_T = strip_sql("text")
_PACK = f"regexp_replace(text, {_quote(f'[{W}]+')}, '', 'g')"


@query(
    "flt05_degenerate",
    f"""SELECT para_id FROM (SELECT para_id, {_T} AS t, {_PACK} AS p FROM {PARA}) WHERE length(t) >= 6 AND (
      (len(regexp_split_to_array(t, {_quote(f'[{W}]+')})) >= 3 AND len(list_distinct(regexp_split_to_array(t, {_quote(f'[{W}]+')}))) = 1) OR (length(p) >= 6 AND replace(p, substr(p, 1, 1), '') = ''))""",
)
def flt05_degenerate(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of one repeated token or character."""
    return paras(spark, d).where(text.degenerate("text")).select("para_id")


@query("flt06_matches", rf"SELECT para_id FROM {PARA} WHERE regexp_matches(text, '(?i)\b(?:table|figure|fig)\b')")
def flt06_matches(spark: SparkSession, d: str) -> DataFrame:
    """A regular-expression predicate with a flag."""
    return paras(spark, d).where(F.col("text").rlike(r"(?i)\b(?:table|figure|fig)\b")).select("para_id")


@query("flt09_substantial_tables", f"SELECT DISTINCT tbl_id FROM odl_tables WHERE len(list_filter(flatten(cells), lambda x: x IS NOT NULL AND {strip_sql('x')} <> '')) > 0 AND bbox[3] - bbox[1] > 20 AND bbox[4] - bbox[2] > 10")
def flt09_substantial_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables with a cell that isn't blank, wider than 20 and higher than 10."""
    t = table(spark, d, "odl_tables", "tbl_id", "cells", "bbox")
    some = F.exists(F.flatten("cells"), lambda x: F.coalesce(text.strip(x) != "", F.lit(False)))
    return t.where(some & (F.col("bbox")[2] - F.col("bbox")[0] > 20) & (F.col("bbox")[3] - F.col("bbox")[1] > 10)).select("tbl_id").distinct()


_LIST = f"((coalesce(kind = 'list item', false) AND (ends OR length(r) > 60)) OR (length(r) > 120 AND ends))"
_REST = f"regexp_replace(regexp_replace(t, {_quote(text.NUMBER_PREFIX)}, ''), {_quote(f'^[{W}]+')}, '')"
_PROSE = rf"(contains(t, '|') OR regexp_matches(t, {_quote(rf'^[（(][{W}]*\p{{Nd}}+[{W}]*[）)][.．]?$')}) OR rest = '' OR starts_with(rest, ':') OR regexp_matches(rest, {_quote(text.CITATION)}) OR len(regexp_extract_all(rest, {_quote(rf'[.!?。][{W}]')})) >= 2)"
_EQ = rf"(contains(t, '=') OR regexp_matches(t, {_quote(rf'\([{W}]*\p{{Nd}}+[{W}]*\)[{W}]*$')}) OR NOT regexp_matches(t, {_quote(text.HEADING_WORD)}))"


@query(
    "flt10_13_vetoes",
    f"""SELECT DISTINCT para_id, {_LIST} AS list_veto, {_PROSE} AS prose_veto, {_EQ} AS equation_veto, regexp_matches(text, {_quote(text.CAPTION_LEAD)}) AS caption_veto, regexp_matches(text, '[A-Za-z][0-9∗*†‡§¶]') AS affiliation_veto FROM (
      SELECT *, {_REST} AS rest, right(r, 1) IN ({', '.join(f"'{c}'" for c in text.TERMINATORS)}) AS ends FROM (
        SELECT para_id, kind, text, {_T} AS t, regexp_replace(text, {_quote(f'[{W}]+$')}, '') AS r FROM odl_paragraphs WHERE text IS NOT NULL AND {_T} <> ''))""",
)
def flt10_13_vetoes(spark: SparkSession, d: str) -> DataFrame:
    """What keeps a line from being a heading."""
    p = paras(spark, d, "kind").where(text.strip("text") != "")
    return p.select(
        "para_id", text.list_veto("text", "kind").alias("list_veto"), text.prose_veto("text").alias("prose_veto"), text.equation_veto("text").alias("equation_veto"),
        F.col("text").rlike(text.CAPTION_LEAD).alias("caption_veto"), F.col("text").rlike("[A-Za-z][0-9∗*†‡§¶]").alias("affiliation_veto"),
    ).distinct()


_LINES = f"(SELECT out_id, document_id, page_index, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT out_id, document_id, page_index, string_split(markdown, chr(10)) AS l FROM {PAGES}))"


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(out_id, document_id, page_index, line_no, line) of every page."""
    got = pages(spark, d).select("out_id", "document_id", "page_index", F.posexplode(F.split("markdown", "\n")).alias("p", "line"))
    return got.select("out_id", "document_id", "page_index", (F.col("p") + 1).alias("line_no"), "line")


_CANDIDATE = f"{strip_sql('line')} <> '' AND NOT regexp_matches({strip_sql('line')}, '^(?:#|\\||>|!\\[|<!--)')"


@query("flt14_furniture_candidates", f"SELECT out_id, line_no FROM {_LINES} WHERE {_CANDIDATE}")
def flt14_furniture_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Lines that may be page furniture."""
    s = text.strip("line")
    return lines(spark, d).where((s != "") & ~s.rlike(r"^(?:#|\||>|!\[|<!--)")).select("out_id", "line_no")


@query("flt16_chart_noise", f"SELECT out_id, string_agg(line, chr(10) ORDER BY line_no) AS kept FROM {_LINES} WHERE NOT regexp_matches({strip_sql('line')}, '^[\\p{{Nd}}.,%·-]+$') GROUP BY out_id")
def flt16_chart_noise(spark: SparkSession, d: str) -> DataFrame:
    """Pages without lines of bare figures."""
    kept = F.filter(F.split("markdown", "\n"), lambda x: ~text.strip(x).rlike(r"^[\p{Nd}.,%·-]+$"))
    return pages(spark, d).select("out_id", kept.alias("k")).where(F.size("k") > 0).select("out_id", F.array_join("k", "\n").alias("kept"))


@query("flt17_placeholders", r"SELECT out_id, regexp_replace(markdown, '(?im)^[ \t]*\[(?:figure|image)\][ \t]*\n?', '', 'g') AS md FROM " + PAGES)
def flt17_placeholders(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("out_id", F.regexp_replace("markdown", r"(?im)^[ \t]*\[(?:figure|image)\][ \t]*\n?", "").alias("md"))


_LATEX = r"=|\\leq|\\geq|\\neq|\\approx|\\sum|\\int|\\prod|\\frac|\\cdot|\\times|\\log"


@query("flt20_display_latex", f"SELECT out_id, pos, latex, regexp_matches(latex, {_quote(_LATEX)}) OR length(latex) >= 15 AS display FROM ({SQL['scl19_equations']})")
def flt20_display_latex(spark: SparkSession, d: str) -> DataFrame:
    return scl19_equations(spark, d).withColumn("display", F.col("latex").rlike(_LATEX) | (F.length("latex") >= 15))


_ROWS = r"len(list_filter(string_split(markdown, chr(10)), lambda x: regexp_matches(x, '^[ \t]*\|.*\|[ \t]*$')))"
_IMAGES = r"len(regexp_extract_all(markdown, '!\[[^\]]*\]\('))"


@query("flt21_route", f"SELECT out_id, CASE WHEN length(markdown) < 20 THEN 'scan_vlm' WHEN {_ROWS} >= 3 THEN 'table_vlm' WHEN {_IMAGES} > 0 THEN 'figure_vlm' ELSE 'deterministic' END AS route FROM {PAGES}")
def flt21_route(spark: SparkSession, d: str) -> DataFrame:
    """The route of each page by its counts; pages here carry no path objects, so that step never fires."""
    rows = F.size(F.filter(F.split("markdown", "\n"), lambda x: x.rlike(r"^[ \t]*\|.*\|[ \t]*$")))
    images = F.regexp_count("markdown", F.lit(r"!\[[^\]]*\]\("))
    route = F.when(F.length("markdown") < 20, "scan_vlm").when(rows >= 3, "table_vlm").when(images > 0, "figure_vlm").otherwise("deterministic")
    return pages(spark, d).select("out_id", route.alias("route"))


@query("src11_table_rows", f"SELECT out_id, {_ROWS} AS n FROM {PAGES}")
def src11_table_rows(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("out_id", F.size(F.filter(F.split("markdown", "\n"), lambda x: x.rlike(r"^[ \t]*\|.*\|[ \t]*$"))).alias("n"))


@query("src04_chars", "SELECT out_id, length(markdown) AS chars FROM " + PAGES)
def src04_chars(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("out_id", F.length("markdown").alias("chars"))


@query("src20_floats", "SELECT DISTINCT tbl_id, r - 1 AS row, c - 1 AS col, try_cast(replace(cells[r][c], ',', '') AS DOUBLE) AS value FROM (SELECT tbl_id, cells, unnest(range(1, len(cells) + 1)) AS r FROM odl_tables), LATERAL (SELECT unnest(range(1, len(cells[r]) + 1)) AS c) WHERE try_cast(replace(cells[r][c], ',', '') AS DOUBLE) IS NOT NULL")
def src20_floats(spark: SparkSession, d: str) -> DataFrame:
    """Numeric cells of tables."""
    t = table(spark, d, "odl_tables", "tbl_id", "cells").select("tbl_id", F.posexplode("cells").alias("row", "cs")).select("tbl_id", "row", F.posexplode("cs").alias("col", "x"))
    return t.withColumn("value", F.replace("x", F.lit(","), F.lit("")).try_cast("double")).where(F.col("value").isNotNull()).select("tbl_id", "row", "col", "value").distinct()
