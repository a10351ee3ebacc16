"""Ordered tagging rules compiled to Columns: one `coalesce` of `when`s for each axis, no UDF.

A rule is {"id", "when", "then"}. `then` may set type, level and zone, and opens_zone for the nodes after it. Type and zone
are filled independently, each by the first rule that sets it. An unknown predicate or operator is an error on compiling.
Comparisons with a null value are false, `not_in` is true of it.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbering, text

#: Fields that rules may compare.
FIELDS = ("page_index", "page_frac", "odl_type", "odl_role", "odl_heading_level", "font_size", "font_rank", "is_landscape")
_NUMERIC = {"gte": "__ge__", "lte": "__le__", "gt": "__gt__", "lt": "__lt__"}

#: The default rules, in their order.
DEFAULT_RULES: tuple[dict[str, Any], ...] = (
    {"id": "noise-furniture", "when": {"text_degenerate": True}, "then": {"zone": "furniture"}},
    {"id": "math-garble-furniture", "when": {"text_matches": r"[ðÐÞþ]|[A-Za-z]\s*¼\s*\p{Nd}"}, "then": {"zone": "furniture"}},
    {"id": "doc-title", "when": {"all": [{"page_index": {"eq": 0}}, {"odl_role": {"in": ["Doctitle", "Title"]}}]}, "then": {"type": "title", "zone": "cover"}},
    {"id": "references-zone", "when": {"all": [{"page_frac": {"gte": 0.4}}, {"text_matches": r"(?i)^\s*(?:\p{Nd}+\.?\s+)?(?:references|bibliography|works\s+cited|literature\s+cited|참고\s*문헌|参考文献)\s*$"}]}, "then": {"zone": "references", "opens_zone": True}},
    {"id": "appendix-zone", "when": {"all": [{"page_frac": {"gte": 0.4}}, {"text_matches": r"(?i)^\s*(?:\p{Nd}+\.?\s+|appendix\s+)?(?:appendix|supplementary|supporting\s+information|부록|附録)(?:$|[^\p{L}\p{N}_])"}]}, "then": {"zone": "appendix", "opens_zone": True}},
    {"id": "toc-zone", "when": {"text_matches": r"(?i)^\s*(?:contents|table\s+of\s+contents|목차|目次)\s*$"}, "then": {"zone": "toc"}},
    {"id": "front-matter-metadata", "when": {"all": [{"page_frac": {"lte": 0.2}}, {"text_matches": r"(?i)^\s*(?:open\s+access|citation\s*:|received\s*:|accepted\s*:|published\s*:|revised\s*:|copyright\b|competing\s+interests\b|conflict\s+of\s+interest|funding\s*:|data\s+availability|abbreviations\s*:|academic\s+editor\b|peer\s+review\s+history|correspondence\s*:|doi\s*:|issn\s*:|©)"}]}, "then": {"zone": "metadata"}},
    {"id": "numbered-heading", "when": {"classify_numbering": "not_null"}, "then": {"type": "heading", "level": "from_numbering"}},
    {"id": "prose-heading", "when": {"any": [{"odl_type": {"eq": "heading"}}, {"odl_role": {"in": ["Subtitle", "Sectiontitle", "Sectionheader"]}}, {"odl_heading_level": {"gte": 1}}]}, "then": {"type": "heading", "level": "from_font_rank"}},
    {"id": "list-item", "when": {"odl_type": {"eq": "list item"}}, "then": {"type": "list_item"}},
    {"id": "default-text", "when": {}, "then": {"type": "paragraph"}},
)


def _compare(name: str, spec: Any) -> Column:
    c = F.col(name)
    if not isinstance(spec, dict):
        return F.coalesce(c == F.lit(spec), F.lit(False)) if spec is not None else c.isNull()
    parts = []
    for op, v in spec.items():
        if op == "eq":
            parts.append(c.isNull() if v is None else F.coalesce(c == F.lit(v), F.lit(False)))
        elif op == "in":
            parts.append(F.coalesce(c.isin(*v), F.lit(False)))
        elif op == "not_in":
            parts.append(F.coalesce(~c.isin(*v), F.lit(True)))
        elif op == "not_null":
            parts.append(c.isNotNull() if v else c.isNull())
        elif op in _NUMERIC:
            parts.append(F.coalesce(getattr(c.cast("string").try_cast("double"), _NUMERIC[op])(F.lit(float(v))), F.lit(False)))
        else:
            raise ValueError(f"unknown operator {op}")
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def predicate(clause: dict[str, Any]) -> Column:
    """A `when` clause as a Column that is never null; all keys must hold."""
    parts = []
    for key, v in clause.items():
        if key == "all":
            parts.append(reduce(lambda a, b: a & b, [predicate(x) for x in v], F.lit(True)))
        elif key == "any":
            parts.append(reduce(lambda a, b: a | b, [predicate(x) for x in v], F.lit(False)))
        elif key == "not":
            parts.append(~predicate(v))
        elif key == "text_degenerate":
            parts.append(text.degenerate("text") == F.lit(bool(v)))
        elif key == "text_matches":
            spec = v if isinstance(v, dict) else {"pattern": v}
            pattern = spec.get("pattern") or spec.get("re") or spec.get("value")
            parts.append(F.coalesce(F.col("text").rlike(("(?i)" if "i" in spec.get("flags", "") else "") + pattern), F.lit(False)))
        elif key == "classify_numbering":
            known = numbering.classify("text").isNotNull()
            parts.append(known if v in ("not_null", True) else ~known if v is False else F.coalesce(numbering.classify("text")["style"] == F.lit(v["eq"]), F.lit(False)))
        elif key in FIELDS:
            parts.append(_compare(key, v))
        else:
            raise ValueError(f"unknown predicate {key}")
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def tagged(nodes: DataFrame, rules: tuple[dict[str, Any], ...] = DEFAULT_RULES) -> DataFrame:
    """nodes with type, level_rule, own_zone, zone_rule and opens_zone, by the first rule of each axis that holds."""
    hits = [(r, predicate(r["when"])) for r in rules]

    def axis(name: str, value) -> Column:
        ways = [F.when(p, F.lit(value(r))) for r, p in hits if name in r["then"]]
        return F.coalesce(*ways) if ways else F.lit(None).cast("string")

    out = nodes.withColumns(
        {
            "type": axis("type", lambda r: r["then"]["type"]),
            "type_rule": axis("type", lambda r: r["id"]),
            "level_rule": axis("type", lambda r: str(r["then"].get("level"))),
            "own_zone": axis("zone", lambda r: r["then"]["zone"]),
            "zone_rule": axis("zone", lambda r: r["id"]),
        }
    )
    openers = [r["id"] for r in rules if r["then"].get("opens_zone")]
    return out.withColumn("opens_zone", F.coalesce(F.col("zone_rule").isin(*openers) | F.col("type_rule").isin(*openers), F.lit(False)))


def carried(nodes: DataFrame, default_zone: str = "body") -> DataFrame:
    """tagged nodes with their zone: their own, else the last opened before them in the document, else the default."""
    w = Window.partitionBy("document_id").orderBy("page_index", "ord", "para_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.last(F.when(F.col("opens_zone"), F.col("own_zone")), ignorenulls=True).over(w)
    return nodes.withColumn("zone", F.coalesce("own_zone", opened, F.lit(default_zone)))


def signals(paragraphs: DataFrame) -> DataFrame:
    """The fields rules see, of rows of odl_paragraphs: page fraction and font rank are of the document."""
    pages = Window.partitionBy("document_id")
    sizes = Window.partitionBy("document_id").orderBy("font_size")
    with_size = F.count("font_size").over(pages)
    rank = F.when(F.col("font_size").isNotNull(), (F.rank().over(sizes) - 1 - F.sum(F.col("font_size").isNull().cast("int")).over(pages)) / with_size)
    return paragraphs.withColumns(
        {
            "page_frac": (F.col("page_index") + 1) / (F.max("page_index").over(pages) + 1),
            "font_rank": rank,
            "odl_type": F.col("kind"),
            "odl_role": F.col("odl_level"),
            "odl_heading_level": F.col("heading_level"),
            "is_landscape": F.lit(False),
        }
    )
