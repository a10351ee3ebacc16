"""Text expressions: patterns as Columns, all inside whole-stage code generation.

Null gives null unless a docstring says otherwise. White space is Unicode white space throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, counted scripts, numbers, in the syntax that Java and RE2 share.
WS = r"\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7A3}"
NUMBER = r"\p{Nd}{1,3}(?:,\p{Nd}{3})+|\p{Nd}+(?:\.\p{Nd}+)?"
#: Terminators, leads and marks of headings, captions, references and contents lines.
TERMINATORS = "。．.!?！？"
CAPTION_LEAD = rf"(?i)^[{WS}]*(?:table|figure|fig\.?|表|図|그림|표)[{WS}]*\p{{Nd}}"
CITATION = r"(?i)https?://|www\.|doi\.org|\bdoi:[\s]|\bPMID\b"
HEADING_WORD = r"[A-Za-z\x{C0}-\x{24F}\x{AC00}-\x{D7A3}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]{3,}"
NUMBER_PREFIX = (
    rf"(?i)^[{WS}]*(?:第[{WS}]*[0-9０-９一二三四五六七八九十百]+[{WS}]*[章節編部篇]|제[{WS}]*\p{{Nd}}+[{WS}]*[장절항편부]|[（(][{WS}]*[0-9０-９a-zA-Z]+[{WS}]*[）)]"
    rf"|[0-9０-９]+(?:[.．][0-9０-９]+)*[.．]?|[\x{{2160}}-\x{{216B}}\x{{2460}}-\x{{2473}}]|chapter[{WS}]+[\p{{L}}\p{{N}}_]+|section[{WS}]+\p{{Nd}}+|part[{WS}]+[\p{{L}}\p{{N}}_]+)[{WS}]*"
)
LEADER = rf"^(.+?)[{WS}]*[·.…‧・]{{3,}}[{WS}]*(\p{{Nd}}+|[ivxlcdmIVXLCDM]+)[{WS}]*$"
REFERENCE = rf"^[{WS}]*(?:\[(\p{{Nd}}+)\]|\((\p{{Nd}}+)\)|(\p{{Nd}}+)[.)]|([\x{{2460}}-\x{{2473}}]))[{WS}]+"
LABEL_NUMBER = r"[0-9０-９][\-.\x{2010}-\x{2015}\x{2212}\x{FF0D}0-9０-９]*"
TABLE_LABEL = rf"(?i)^[<〈【［(]?[{WS}]*((?:table|tab\.?|表|표)[{WS}]*{LABEL_NUMBER})"
FIGURE_LABEL = rf"(?i)^[<〈【［(]?[{WS}]*((?:figure|figs?\.?|fig\.?|図|圖|图|그림)[{WS}]*{LABEL_NUMBER})"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.regexp_replace(col(c), rf"^[{WS}]+|[{WS}]+$", "")


def clean(c) -> Column:
    """Control characters to spaces, runs of spaces to one, ends stripped."""
    return strip(F.regexp_replace(F.regexp_replace(col(c), r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}]", " "), " {2,}", " "))


def numbers(c) -> Column:
    """Numbers in reading order, without thousands commas."""
    return F.transform(F.regexp_extract_all(col(c), F.lit(NUMBER), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")))


def numbers_from(c, least: float) -> Column:
    return F.filter(numbers(c), lambda x: F.coalesce(x.try_cast("double") >= F.lit(least), F.lit(False)))


def approx_tokens(c) -> Column:
    """Counted characters, and 1.3 for each word of other scripts, rounded half to even."""
    words = F.regexp_count(col(c), F.lit(rf"[^{WS}{CJK}]+"))
    return F.regexp_count(col(c), F.lit(f"[{CJK}]")) + F.rint(words * F.lit(1.3)).cast("int")


def norm_block(c) -> Column:
    """A block for comparison: marks off, white space collapsed, small letters."""
    t = F.regexp_replace(col(c), rf"^[#>*{WS}]+", "")
    return F.lower(strip(F.regexp_replace(F.regexp_replace(t, r"[*_`#>]", ""), rf"[{WS}]+", " ")))


def line_key(c) -> Column:
    """A line for recurrence: punctuation to spaces, digit runs masked."""
    t = F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}\p{M}]+", " ")
    return strip(F.regexp_replace(F.regexp_replace(t, r"\p{Nd}+", "#"), " {2,}", " "))


def degenerate(c) -> Column:
    """Six characters or more of one repeated token (three times or more) or one repeated character."""
    t = strip(c)
    words = F.split(t, rf"[{WS}]+")
    packed = F.regexp_replace(t, rf"[{WS}]+", "")
    one = (F.length(packed) >= 6) & (F.length(F.replace(packed, F.substring(packed, 1, 1), F.lit(""))) == 0)
    return F.coalesce((F.length(t) >= 6) & (((F.size(words) >= 3) & (F.size(F.array_distinct(words)) == 1)) | one), F.lit(False))


def list_veto(c, kind) -> Column:
    """A numbered line that is a list item and no heading."""
    t = F.regexp_replace(col(c), rf"[{WS}]+$", "")
    ends = F.substring(t, -1, 1).isin(*TERMINATORS)
    return ((F.coalesce(col(kind) == "list item", F.lit(False))) & (ends | (F.length(t) > 60))) | ((F.length(t) > 120) & ends)


def prose_veto(c) -> Column:
    """A numbered line that is a citation, a table row or prose."""
    t = strip(c)
    rest = F.regexp_replace(F.regexp_replace(t, NUMBER_PREFIX, ""), rf"^[{WS}]+", "")
    bare = t.rlike(rf"^[（(][{WS}]*\p{{Nd}}+[{WS}]*[）)][.．]?$")
    return t.contains("|") | bare | (rest == "") | rest.startswith(":") | rest.rlike(CITATION) | (F.regexp_count(rest, F.lit(rf"[.!?。][{WS}]")) >= 2)


def equation_veto(c) -> Column:
    t = strip(c)
    return t.contains("=") | t.rlike(rf"\([{WS}]*\p{{Nd}}+[{WS}]*\)[{WS}]*$") | ~t.rlike(HEADING_WORD)


def reference_marker(c) -> Column:
    """The mark at the head of a reference entry; null if there is none."""
    got = [F.nullif(F.regexp_extract(col(c), REFERENCE, i), F.lit("")) for i in (1, 2, 3, 4)]
    return F.coalesce(*got)


def token_set(c) -> Column:
    """Distinct words of small Latin letters, digits and Hangul, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"[0-9a-z\x{AC00}-\x{D7A3}]+"), F.lit(0))))


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - shared / all of two word sets; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(a, b)) / both)


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two sets: 1 if both are empty, 0 without overlap."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(shared == 0, F.lit(0.0)).otherwise(2 * shared / (F.size(a) + F.size(b)))


def table_markdown(cells) -> Column:
    """Rows of cells as a pipe table; null if there are none."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(col(cells)[0])))
    lines = F.transform(col(cells), row)
    return F.when(F.size(col(cells)) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 1_000_000)), "\n"))


def canonical_table(c) -> Column:
    """Table HTML with header cells as cells and no sections."""
    t = F.regexp_replace(col(c), r"(?i)<(/?)th\b", "<$1td")
    return F.regexp_replace(t, r"(?i)</?t(?:head|body|foot)\b[^>]*>", "")


def evaluation_form(c) -> Column:
    """Text for scoring: tags and marks off, white space collapsed, small letters."""
    t = F.regexp_replace(col(c), r"<[a-zA-Z/][^>]*>", " ")
    t = F.regexp_replace(t, r"[#*_`|>~-]+", " ")
    return F.lower(strip(F.regexp_replace(t, rf"[{WS}]+", " ")))
