"""Chunks of documents: a parent per unit (section, or page outside sections), children packed under a token budget.

Units are worked on one by one, so a long document is spread over many tasks; only the links between children are made over
a whole document, from rows without text.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import CJK

_COUNTED = re.compile("[" + re.sub(r"\\x\{(\w+)\}", r"\\u\1", CJK) + "]")
_WORDS = re.compile(r"[^\s\x1c-\x1f\x85]+")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")
SCHEMA = "document_id string, unit bigint, child bigint, structural_type string, zone string, display_text string, token_count bigint, first_node bigint, last_node bigint, first_page bigint, last_page bigint, is_continuation boolean"

_KINDS = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
_COLUMNS = [(n, _KINDS[k]) for n, k in (c.split() for c in SCHEMA.split(", "))]


def approx_tokens(text: str) -> int:
    """The size estimate of the functions module, for a Python string."""
    counted = len(_COUNTED.findall(text))
    return counted + round(1.3 * len(_WORDS.findall(_COUNTED.sub(" ", text))))


def pack(nodes: list[tuple[int, str, str]], budget: int, atomic: set[str]) -> list[tuple[str, list[int], str]]:
    """(type, node positions, text) of the children of one unit, from (position, type, text) in reading order.

    Texts are joined until the joined size reaches the budget. An atomic node is a child of its own. A single paragraph
    of that size goes out in runs of its sentences, white space at its end left out."""
    out: list[tuple[str, list[int], str]] = []
    held: list[tuple[int, str]] = []

    def flush():
        if held:
            out.append(("text", [p for p, _ in held], "\n".join(t for _, t in held if t)))
            held.clear()

    for at, kind, text in nodes:
        if kind in atomic:
            flush()
            out.append((kind, [at], text))
        elif not held and approx_tokens(text) >= budget:
            run: list[str] = []
            for s in filter(None, _SENTENCE.split(text)):
                run.append(s)
                if approx_tokens(" ".join(run)) >= budget:
                    out.append(("text", [at], " ".join(run)))
                    run = []
            if run:
                out.append(("text", [at], " ".join(run)))
        else:
            held.append((at, text))
            if approx_tokens("\n".join(t for _, t in held if t)) >= budget:
                flush()
    flush()
    return out


def units(nodes: DataFrame) -> DataFrame:
    """nodes with unit: runs of equal section in reading order, of equal page where there is no section; from 1."""
    w = Window.partitionBy("document_id").orderBy("pos")
    key = F.when(F.col("section").isNotNull(), F.concat(F.lit("s"), F.col("section").cast("string"))).otherwise(F.concat(F.lit("p"), F.col("page_index").cast("string")))
    fresh = F.when(F.lag("unit_key").over(w) == F.col("unit_key"), 0).otherwise(1)
    return nodes.withColumn("unit_key", key).withColumn("fresh", fresh).withColumn("unit", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def children(nodes: DataFrame) -> DataFrame:
    """The children of every unit, of rows of (document_id, unit, pos, page_index, type, zone, text, child_tokens, keep_atomic).

    Units are dealt out and sorted by the engine and read as a stream, so a task holds the texts of one unit at a time."""

    def of_unit(rows: list[dict]) -> list[tuple]:
        page = {r["pos"]: r["page_index"] for r in rows}
        zones: dict[str, int] = {}
        for r in rows:
            if r["zone"]:
                zones[r["zone"]] = zones.get(r["zone"], 0) + 1
        zone = max(zones, key=zones.get) if zones else "body"
        got = pack([(r["pos"], r["type"], r["text"] or "") for r in rows], rows[0]["child_tokens"], set(rows[0]["keep_atomic"] or ()))
        out = []
        for k, (kind, at, text) in enumerate(got, 1):
            pages = [page[p] for p in at]
            out.append((rows[0]["document_id"], rows[0]["unit"], k, kind, zone, text, approx_tokens(text), at[0], at[-1], min(pages), max(pages), kind == "text" and k > 1 and got[k - 2][0] == "text"))
        return out

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, (_, kind) in enumerate(_COLUMNS)], names=[n for n, _ in _COLUMNS])

    def run(batches):
        held: list[dict] = []
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                if held and (r["document_id"], r["unit"]) != (held[0]["document_id"], held[0]["unit"]):
                    out += of_unit(held)
                    held = []
                held.append(r)
            yield batch(out)
        if held:
            yield batch(of_unit(held))

    dealt = nodes.repartition("document_id", "unit").sortWithinPartitions("document_id", "unit", "pos")
    return dealt.mapInArrow(run, SCHEMA)


def linked(child: DataFrame) -> DataFrame:
    """children with their ids, the parent's id, and the ids before and after in the document."""
    pad = F.lpad(F.col("unit").cast("string"), 4, "0")
    number = F.when(F.length(F.col("unit").cast("string")) >= 4, F.col("unit").cast("string")).otherwise(pad)
    w = Window.partitionBy("document_id").orderBy("unit", "child")
    got = child.withColumn("chunk_id", F.concat(F.lit("c"), number, F.lit("_"), F.col("child").cast("string"))).withColumn("parent_id", F.concat(F.lit("c"), number, F.lit("p")))
    return got.withColumn("prev", F.lag("chunk_id").over(w)).withColumn("next", F.lead("chunk_id").over(w))
