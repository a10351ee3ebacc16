"""Numbering prefixes of headings, as a Column of (rank, name, style, tier, depth), and the levels they imply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, col

#: Prefix patterns with their rank, name, style and tier, in the order they are tried. `decimal` has the rank
#: and name of its depth.
PREFIXES = (
    (rf"(?i)^(?:第[{WS}]*[0-9０-９一二三四五六七八九十百]+[{WS}]*[章編部篇]|제[{WS}]*[0-9]+[{WS}]*[장편부]|(?:chapter|part)[{WS}]+[0-9ivxlc]+\b|[\x{{2160}}-\x{{216B}}]+[{WS}]*[.．、])", 1, "chapter", "chapter", 0),
    (rf"(?i)^(?:第[{WS}]*[0-9０-９一二三四五六七八九十]+[{WS}]*節|제[{WS}]*[0-9]+[{WS}]*절|section[{WS}]+[0-9]+\b)", 2, "section", "section", 1),
    (rf"^제[{WS}]*[0-9]+[{WS}]*조", 2, "section", "ko_article", 2),
    (rf"^[（(][{WS}]*[0-9０-９]+[{WS}]*[）)]", 3, "subsection", "paren", 2),
    (rf"^제[{WS}]*[0-9]+[{WS}]*[항호관목]", 3, "subsection", "ko_subdiv", 2),
    (rf"^[0-9０-９]+(?:[.．][0-9０-９]+)*[.．]?[{WS}]+[^0-9０-９{WS}]", 0, "", "decimal", 2),
    (r"^[0-9０-９]+\)", 3, "subsection", "num_paren", 2),
    (r"^[\x{2460}-\x{2473}]", 4, "item", "circled", 2),
    (r"^[（(][a-zA-Z][）)]", 4, "item", "latin_paren", 2),
    (r"^[가나다라마바사아자차카타파하][.)．]", 4, "item", "hangul_letter", 2),
)
DECIMAL = r"^([0-9０-９]+(?:[.．][0-9０-９]+)*)"
FIELDS = "struct<rank: int, name: string, style: string, tier: int, depth: int>"


def classify(c) -> Column:
    """The numbering of a heading text; null without a known prefix."""
    t = F.regexp_replace(col(c), rf"^[{WS}]+", "")
    depth = F.length(F.regexp_replace(F.regexp_extract(t, DECIMAL, 1), r"[^.．]", "")) - F.length(F.regexp_replace(F.regexp_extract(t, DECIMAL, 1), r"[^．]", "")) + 1
    out = None
    for pattern, rank, name, style, tier in PREFIXES:
        if style == "decimal":
            name_col = F.when(depth == 1, "section").when(depth == 2, "subsection").otherwise("item")
            v = F.struct(F.least(depth + 1, F.lit(4)).alias("rank"), name_col.alias("name"), F.concat(F.lit("decimal:"), depth.cast("string")).alias("style"), F.lit(tier).alias("tier"), depth.alias("depth"))
        else:
            v = F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("name"), F.lit(style).alias("style"), F.lit(tier).alias("tier"), F.lit(None).cast("int").alias("depth"))
        v = v.cast(FIELDS)
        out = F.when(t.rlike(pattern), v) if out is None else out.when(t.rlike(pattern), v)
    return out


def levels(signatures: list[tuple[str, int, int | None] | None]) -> list[int | None]:
    """The level of each heading of one document, from (style, tier, depth); None where there is no numbering.

    Open headings are kept from the outermost in. A chapter closes all, a section all but the chapters; a decimal goes
    one below the open decimal that is one shallower; a style that is open goes where it was; a new one goes innermost."""
    opened: list[tuple[str, int, int | None, int]] = []  # (style, tier, depth, level)
    out: list[int | None] = []
    for s in signatures:
        if s is None:
            out.append(None)
            continue
        style, tier, depth = s
        if tier == 0:
            keep = 0
        elif tier == 1:
            keep = max((i + 1 for i, o in enumerate(opened) if o[1] == 0), default=0)
        else:
            outer = max((i for i, o in enumerate(opened) if depth is not None and o[2] == depth - 1), default=None)
            same = max((i for i, o in enumerate(opened) if o[0] == style), default=None)
            keep = outer + 1 if outer is not None else same if same is not None else len(opened)
            if outer is None and same is not None:
                level = opened[same][3]
                opened = [*opened[:keep], (style, tier, depth, level)]
                out.append(level)
                continue
        opened = opened[:keep]
        level = opened[-1][3] + 1 if opened else 1
        opened.append((style, tier, depth, level))
        out.append(level)
    return out
