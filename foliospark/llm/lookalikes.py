"""Problem 2: visually identical text with different characters.

Every value gets one form: Unicode compatibility decomposition, white space mapped one to one to the plain space,
default-ignorable characters removed, look-alike letters of other scripts mapped to the Latin twin (one map, whatever the
word, so that accented letters on twins meet too), look-alike hyphens to one hyphen, then composition. One table serves all
texts. The forms of distinct values of a batch are computed once. The form is for comparison: a Cyrillic word comes out
partly Latin in it; `readable` leaves the twins alone.

Full case folding is part of the method, but in this project's data upper and lower case differ, so `canonical` keeps case
and p2_forms gives the folded form beside it. Line breaks and the number of spaces count. Straight and curly quotation marks
stay different.

Defined results: null gives null; a blank or empty value gives a form but never a pair, nor does a row without a document;
texts of any length are handled whole; repeated rows are one row; equal characters are no case.
"""

from __future__ import annotations

import re
import sys
from unicodedata import category, normalize

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, durable, not_blank, read, spread

#: Letters that look like the Latin letter below them (Cyrillic, then Greek).
CYRILLIC_TWINS = "аеорсухѕіјһԁԛԝАВЕКМНОРСТХЅІЈҮ"
CYRILLIC_LATIN = "aeopcyxsijhdqwABEKMHOPCTXSIJY"
GREEK_TWINS = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϹ"
GREEK_LATIN = "ABEZHIKMNOPTYXovcC"
#: The same of further Cyrillic, Armenian and Latin letters.
OTHER_TWINS = "ӏԌօհոսıɡ"
OTHER_LATIN = "lGohnuig"
#: Hyphens that look like the hyphen-minus.
HYPHENS = "‐‑‒⁃−"
#: Ranges of default-ignorable code points, from the Unicode property Default_Ignorable_Code_Point.
IGNORABLE_RANGES = "00AD 034F 061C 115F-1160 17B4-17B5 180B-180F 200B-200F 202A-202E 2060-206F 3164 FE00-FE0F FEFF FFA0 FFF0-FFF8 1BCA0-1BCA3 1D173-1D17A E0000-E0FFF"


def _ignorables() -> list[int]:
    out = []
    for part in IGNORABLE_RANGES.split():
        a, _, b = part.partition("-")
        out += range(int(a, 16), int(b or a, 16) + 1)
    return out


#: One table for what doesn't depend on context: ignorables go, white space becomes a space, hyphens one hyphen.
_TABLE: dict[int, str | None] = dict.fromkeys(_ignorables())
_TABLE |= {c: " " for c in range(sys.maxunicode) if category(chr(c)) == "Zs" and c != 0x20} | {ord("\t"): " "}
_TABLE |= dict.fromkeys(map(ord, HYPHENS), "-") | dict.fromkeys(map(ord, "\r\u2028\u2029\x0b\x0c\x85"), "\n")
_ODD_ASCII = re.compile(r"[\t\r\x0b\x0c]")
_TO_LATIN = str.maketrans(CYRILLIC_TWINS + GREEK_TWINS + OTHER_TWINS, CYRILLIC_LATIN + GREEK_LATIN + OTHER_LATIN)
_OTHER_SCRIPT = re.compile(r"[\u0370-\u058f\u1f00-\u1fff\u0131\u0261]")  # where twins are, composed or not
_TWINS = re.compile(f"[{CYRILLIC_TWINS}{GREEK_TWINS}{OTHER_TWINS}]")


def readable(text: str) -> str:
    """The one form of a value, letters left in their script."""
    if text.isascii() and not _ODD_ASCII.search(text):
        return text
    return normalize("NFKC", text.replace("\r\n", "\n").translate(_TABLE)).translate(_TABLE)


def canonical(text: str) -> str:
    """The one form of a value, for comparison. canonical(canonical(x)) == canonical(x)."""
    text = readable(text)
    if not text.isascii() and _OTHER_SCRIPT.search(text) and _TWINS.search(d := normalize("NFD", text)):
        text = normalize("NFC", d.translate(_TO_LATIN))
    return text


def _fold(text: str) -> str:
    return normalize("NFC", text.casefold())


def _forms(values: pa.Array, f=canonical) -> pa.Array:
    """f of each value, computed once per distinct value of the batch."""
    d = pc.dictionary_encode(values)
    forms = pa.array([None if x is None else f(x) for x in d.dictionary.to_pylist()], pa.string())
    return forms.take(d.indices)


def with_form(df: DataFrame, text_col: str, form_col: str = "form", fold_col: str | None = None) -> DataFrame:
    """df with the one form of text_col, and with its case-folded form if a name for that is given."""
    names = [f.name for f in df.schema]
    for name in (form_col, fold_col):
        if name in names:
            raise ValueError(f"there is a column {name} already")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{form_col}` string" + (f", `{fold_col}` string" if fold_col else "")

    def run(b: pa.RecordBatch) -> dict:
        out = {n: b.column(i) for i, n in enumerate(names)}
        out[form_col] = _forms(b.column(names.index(text_col)))
        if fold_col:
            out[fold_col] = _forms(out[form_col], _fold)
        return out

    return arrow_map(df, run, ddl)


#: rec, id column and text column of the tables of the problem.
RECORDS = (("odl_paragraphs", "para_id", "text"), ("odl_tables", "tbl_id", "label"), ("odl_captions", "cap_id", "text"))


HOT, SALTS = 5000, 16  #: members above which a group is dealt out over tasks, and over how many


def _unlike(df: DataFrame) -> DataFrame:
    """Pairs of rows of (rec, document_id, id, text, form) in one group with one form and different characters.

    Only hashes move. Groups of one spelling, nearly all, never reach the join; a hot group is joined in salted parts."""
    keys = ["rec", "document_id", "form", "form2"]
    look = [F.xxhash64("form", F.lit(1)).alias("form"), F.xxhash64("form", F.lit(2)).alias("form2")]
    spelt = durable(df.select("rec", "document_id", "id", *look, F.struct(F.xxhash64("text"), F.xxhash64("text", F.lit(7))).alias("spelling")))  # repeated rows fall out with the pairs
    groups = spelt.groupBy(*keys).agg(F.min("spelling").alias("a"), F.max("spelling").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select(*keys, "n")
    rows = spelt.join(groups, keys).withColumn("salts", F.when(F.col("n") > HOT, SALTS).otherwise(1))
    left = rows.select(*keys, F.col("id").alias("x"), F.col("spelling").alias("s"), F.pmod(F.xxhash64("id"), F.col("salts")).alias("salt"))
    right = rows.select(*keys, F.col("id").alias("y"), F.col("spelling").alias("t"), F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("salts") - 1).cast("bigint"))).alias("salt"))
    pairs = left.join(right, [*keys, "salt"]).where((F.col("s") < F.col("t")) & (F.col("x") != F.col("y")))
    return pairs.select("rec", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, document_id, id, text, form) of every non-blank value of the three tables."""
    parts = [
        with_form(spread(read(spark, sf_dir, t, "document_id", i, c)).where(not_blank(c)).select(F.lit(t).alias("rec"), "document_id", F.col(i).alias("id"), F.col(c).alias("text")), "text")
        for t, i, c in RECORDS
    ]
    return parts[0].union(parts[1]).union(parts[2])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows of one table and document that look the same but are not the same characters."""
    return _unlike(forms(spark, sf_dir).where(F.col("document_id").isNotNull()))


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, id, text, form, folded): each value with its one form and its case-folded form."""

    def run(b: pa.RecordBatch) -> dict:
        out = {n: b.column(i) for i, n in enumerate(("rec", "id", "text", "form"))}
        return out | {"folded": _forms(b.column(3), _fold)}

    return arrow_map(forms(spark, sf_dir).select("rec", "id", "text", "form").distinct(), run, "rec string, id bigint, text string, form string, folded string")
